"""Names that operators use inside belong to the caller: values come back as they were, in any case of letters."""

import pytest
from pyspark.sql import functions as F

from sluice.llm.embed_dedup import embedding_near_dedup
from sluice.llm.line_dedup import line_dedup
from sluice.llm.mixing import INNER, mix
from sluice.llm.pii import find_pii
from sluice.llm.quality import fit_quality, score_quality
from sluice.llm.simhash import simhash_near_dedup

LINE = "a line that is long enough to count"
ROWS = [(i, f"{LINE}\nown words of document {i} mail a{i}@b.org", "abc"[i % 3]) for i in range(9)]


def docs(spark, names):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    return df.withColumns({n: F.concat(F.lit(f"{n}-"), "doc_id") for n in names})


def plain(df, names):
    cols = [c for c in df.columns if c not in names]
    return sorted(map(str, df.select(*cols).collect()))


def operators(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(9)], "doc_id long, quality int")
    model = fit_quality(docs(spark, []), labels)
    return {
        "line": (line_dedup, ("_kept", "_gone_doc", "_gone_keys", "doc", "gone", "home", "h1")),
        "quality": (lambda d: score_quality(d, model), ("_score", "x", "y")),
        "pii": (find_pii, ("_spans", "kind")),
        "simhash": (simhash_near_dedup, ("_kept", "_nth", "fp", "rep", "component", "id")),
        "mix": (mix, (*INNER, "size", "weight", "rate", "place")),
    }


@pytest.mark.parametrize("upper", [False, True])
@pytest.mark.parametrize("name", ["line", "quality", "pii", "simhash", "mix"])
def test_inner_names(spark, name, upper):
    run, names = operators(spark)[name]
    names = [n.upper() if upper else n for n in names]
    without, out = run(docs(spark, [])), run(docs(spark, names))
    assert set(names) <= set(out.columns) and set(out.columns) - set(names) == set(without.columns)
    assert all(r[n] == f"{n}-{r['doc_id']}" for r in out.collect() for n in names)
    if name != "mix":  # a row's draws may depend on its other columns only where its id doesn't tell it apart
        assert plain(out, names) == plain(without, names)
    else:
        assert plain(out, names) == plain(without, [])


def test_mixing_with_repeated_ids_and_inner_names(spark):
    df = docs(spark, list(INNER))
    out = mix(df.unionByName(df).unionByName(df.withColumn("doc_id", F.lit(None).cast("long"))))
    assert set(INNER) <= set(out.columns) and out.count() > 0


def test_text_column_in_another_case(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, Text string, source string")
    out = line_dedup(df).orderBy("doc_id").collect()
    assert [r["n_dropped"] for r in out] == [1] * 8 + [0]
    assert all(LINE not in r["Text"] for r in out[:8]) and LINE in out[8]["Text"]


def test_embedding_near_dedup(spark):
    df = spark.createDataFrame([(i, [1.0, float(i // 2)], f"k{i}", "z") for i in range(6)], "vec_id long, embedding array<double>, _kept string, v string")
    out = embedding_near_dedup(df)
    assert sorted(out.columns) == sorted(df.columns) and all(r["_kept"] == f"k{r['vec_id']}" for r in out.collect())
