"""Providers as data sources: batch, pushed filters, and streams that resume."""

from pyspark.sql import functions as F

from lodestack.scratch import new_path
from lodestack.sources.providers import register_provider


def test_batch_filters_and_resuming_stream(spark):
    root = new_path(spark, "pages")

    def pages(options):
        import os

        return sorted(f"{options['root']}/{f}" for f in os.listdir(options["root"]) if f.endswith(".txt"))

    def read(options, page, wanted):
        with open(page) as f:
            for line in f:
                title, year = line.strip().split("|")
                if "year" in wanted:  # seen in the title, so that the test knows
                    title = f"{title} of {wanted['year']}"
                yield title, int(year)

    import os

    os.makedirs(root)

    def publish(n, rows):
        with open(f"{root}/{n:04}.txt", "w") as f:
            f.write("\n".join(f"{t}|{y}" for t, y in rows))

    publish(1, [("a", 2020), ("b", 2021)])
    publish(2, [("c", 2020)])
    register_provider(spark, "paged", "title string, year int", pages, read)
    load = lambda: spark.read.format("paged").option("root", root).load()
    assert sorted(map(tuple, load().collect())) == [("a", 2020), ("b", 2021), ("c", 2020)]
    assert load().rdd.getNumPartitions() == 2
    assert sorted(r.title for r in load().filter("year = 2020").collect()) == ["a of 2020", "c of 2020"]

    out, log = new_path(spark, "read"), new_path(spark, "log")

    def run():
        stream = spark.readStream.format("paged").option("root", root).load()
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
        return sorted(r.title for r in spark.read.parquet(out).collect())

    assert run() == ["a", "b", "c"]
    publish(3, [("d", 2022), ("e", 2023)])
    assert run() == ["a", "b", "c", "d", "e"]  # only the new page was read
    assert run() == ["a", "b", "c", "d", "e"]
    assert spark.read.parquet(out).agg(F.count("*")).first()[0] == 5
