"""Groups of a key: no pair is verified twice, and where all members of a key meet, only
pairs that hold are made."""

from pyspark.sql import functions as F

from corpusrank.llm import linking


def run(spark, last):
    """60 items under two keys; an item belongs to the one whose half it shares."""
    keyed = spark.createDataFrame([(k, i) for k in (1, 2) for i in range(60)], "key long, id long")
    items = spark.createDataFrame([(i, 5) for i in range(60)], "id long, n int")
    calls = []

    def verify(pairs):
        calls.append([(r.a, r.b) for r in pairs.collect()])
        return pairs.where("a DIV 2 = b DIV 2")

    comp, _ = linking.link(keyed, items, ["n"], lambda x, y: F.lit(True), verify, lambda ids: ids.select("id", F.expr("id DIV 2").alias("half")), [],
                           None, last=last, last_attrs=["half"])
    return {r["id"]: r["component"] for r in comp.collect()}, calls


def test_full_comparison_makes_only_pairs_that_hold(spark, monkeypatch):
    want = {i: i - i % 2 for i in range(60)}
    for size in (512, 7):                    # 7: a key's pairs in nine slices
        monkeypatch.setattr(linking, "SLICE", size)
        got, calls = run(spark, lambda x, y: F.col(f"{x}half") == F.col(f"{y}half"))
        assert got == want
        assert len(calls[-1]) == 29          # 0 and 1 are linked in the first round
        pairs = [p for c in calls for p in c]
        assert len(pairs) == len(set(pairs))
