"""Work folder and settings."""

from sluice.session import ENGINE_SETTINGS, ensure_settings, scratch_path, work_root


def test_work_root_follows_checkpoint_dir(spark):
    root = work_root(spark)
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    assert conf and root == conf.rstrip("/")
    a, b = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert a != b and a.startswith(root + "/sluice/x/")


def test_ensure_settings(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    ensure_settings(spark)
    for k, v in ENGINE_SETTINGS.items():
        assert spark.conf.get(k) == v


def test_a_cluster_needs_a_shared_folder():
    import pytest

    from sluice.session import require_local

    require_local("local[4]")
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://host"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            require_local(master)
