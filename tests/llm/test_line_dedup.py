"""Line dedup against a plain-Python reading."""

import random
from collections import defaultdict

from sluice.llm.line_dedup import line_dedup

BLANKS = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _brute(rows):
    held = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if i is not None:
                held[line.strip(BLANKS).translate(LOWER)].add(i)
    home = {k: max(v) for k, v in held.items() if len(k) >= 20 and len(v) >= 3}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [line for line in lines if i is None or home.get(line.strip(BLANKS).translate(LOWER), i) == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def _got(spark, rows):
    df = spark.createDataFrame([(i, t, "a", 7) for i, t in rows], "doc_id long, text string, N_Lines string, gone int")
    out = line_dedup(df)
    assert out.columns == ["doc_id", "text", "gone", "n_lines", "n_dropped"]
    return sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in out.collect()), key=str)


def test_cases(spark):
    line, other = "A line of over twenty letters ÀÉ", "x" * 19
    rows = [
        (1, f"{line}\nmine\n{line}"),
        (2, f" \t{line.replace('A', 'a')}\r\n{other}"),
        (3, f"{other}\n{line}\n\n{line}"),
        (4, f"{line.lower()}\n{other}"),  # other letters beyond A-Z: another key
        (5, None),
        (6, ""),
        (None, f"{line}\n{other}"),
        (2, line),
        (7, "y" * 20 + "\n" + line * 5000),
        (8, "y" * 20),
        (9, "Y" * 20 + "\x0b"),
    ]
    assert _got(spark, rows) == _brute(rows)


def test_random_texts(spark):
    rnd = random.Random(5)
    pool = ["".join(rnd.choice("abC é\t") for _ in range(rnd.randint(0, 40))) for _ in range(60)]
    rows = [(i, "\n".join(rnd.choices(pool, k=rnd.randint(0, 12)))) for i in range(200)]
    assert _got(spark, rows) == _brute(rows)


def test_no_rows(spark):
    assert _got(spark, []) == []
