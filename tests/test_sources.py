"""Work folders: where they lie, and that they go."""

import os


def test_work_folders_go(spark):
    from tessera import sources

    table = sources.kept(spark.range(5), "numbers")
    path = sources._made[-1][1]
    assert path.startswith(spark.sparkContext.getConf().get("spark.checkpoint.dir")) and table.count() == 5
    os.makedirs(f"{path}-checkpoint")
    before = list(sources._made)
    sources._made[:] = [(spark, path)]
    sources.clear()
    assert not os.path.exists(path) and not os.path.exists(f"{path}-checkpoint") and sources._made == []
    sources._made[:] = [m for m in before if m[1] != path]
