"""Secret scan with an incremental blob ledger.

Every text version is content-addressed: its blob is the SHA-256 of its bytes.
The ledger is a table of (blob, rule, rule_version, start, end); a row without
a span says that the blob was scanned and nothing was found.  A run takes one
representative row per blob, drops the (blob, rule, rule_version) triples that
the ledger already has, scans only those texts, appends, and joins the ledger's
findings back to every path (row) that carries the blob.  Raising a rule's
version scans all blobs again for that rule alone.

Spans come from built-in functions: splitting a text at a rule's matches gives
the gaps, extracting gives the matches, and a running sum of their lengths
gives code-point offsets.  The sum is a window over one blob's matches of one
rule, so it is bounded by one text.  Text moves once, keyed by row id; paths
join on the blob by sort-merge, whose hot blobs Spark splits.

Null text is the empty blob, without findings.  Null ids are one path;
repeated rows repeat their answer.  An empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusrank.llm.common import saved, scratch_path, text_or_empty


@dataclass(frozen=True)
class Rule:
    name: str
    version: int
    pattern: str
    group: int       # the group whose length decides
    min_chars: int


# The base rules, in their listed order.
RULES = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", 1, r"[0-9a-f]+", 0, 16),
)
LEDGER = "blob binary, rule string, rule_version int, start long, end long"
PAIR = ["blob", "rule", "rule_version"]


def blobs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    t = text_or_empty(text_col)
    return docs.select(F.col(id_col).alias("path"), F.unhex(F.sha2(t.cast("binary"), 256)).alias("blob"), t.alias("text"))


def scan(texts: DataFrame, rules=RULES) -> DataFrame:
    """Ledger rows for ``(blob, text, todo)``; ``todo`` names the rules to run."""
    def one(r: Rule):
        t, p = F.col("text"), F.lit(r.pattern)
        run = F.array_contains("todo", r.name)
        # runs shorter than min_chars can't be findings of a one-class rule: skip texts without any
        found = run & t.rlike(rf"{r.pattern[:-1]}{{{r.min_chars},}}" if r.name == "hex" else r.pattern)
        cells = F.arrays_zip(
            F.transform(F.split(t, r.pattern), lambda s: F.length(s)).alias("gap"),
            F.transform(F.regexp_extract_all(t, p, F.lit(0)), lambda s: F.length(s)).alias("len"),
            F.transform(F.regexp_extract_all(t, p, F.lit(r.group)), lambda s: F.length(s) >= r.min_chars).alias("ok"))
        none = F.lit(None).cast("array<struct<gap:int,len:int,ok:boolean>>")
        return F.struct(run.alias("run"), F.lit(r.name).alias("rule"), F.lit(r.version).alias("rule_version"),
                        F.when(found, cells).otherwise(none).alias("cells"))

    per_rule = (texts.select("blob", F.explode(F.array(*[one(r) for r in rules])).alias("r"))
                .where("r.run").select("blob", "r.rule", "r.rule_version", "r.cells"))
    cells = per_rule.select(*PAIR, F.posexplode_outer("cells").alias("pos", "c"))
    upto = Window.partitionBy(*PAIR).orderBy("pos")
    end = F.sum(F.col("c.gap") + F.coalesce(F.col("c.len"), F.lit(0))).over(upto)
    return (cells.withColumn("end", end.cast("long"))
            .select(*PAIR, F.expr("IF(c.ok, end - c.len, NULL)").cast("long").alias("start"),
                    F.expr("IF(c.ok, end, NULL)").cast("long").alias("end"), "pos")
            .where("start IS NOT NULL OR coalesce(pos, 0) = 0").drop("pos").dropDuplicates())


def update_ledger(docs: DataFrame, ledger: DataFrame | None, rules=RULES,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ledger rows of the (blob, rule, version) triples not yet in ``ledger``."""
    spark = docs.sparkSession
    versions = blobs(docs, id_col, text_col)
    wanted = spark.createDataFrame([(r.name, r.version) for r in rules], "rule string, rule_version int")
    reps = versions.groupBy("blob").agg(F.min("path").alias("path"))
    if ledger is None:
        todo = reps.withColumn("todo", F.array(*[F.lit(r.name) for r in rules]))
    else:
        pairs = reps.select("blob", "path", F.explode(F.array(*[
            F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("rule_version")) for r in rules])).alias("r"))
        seen = ledger.join(wanted, ["rule", "rule_version"]).select(*PAIR).dropDuplicates()
        todo = (pairs.select("blob", "path", "r.rule", "r.rule_version").join(seen, PAIR, "left_anti")
                .groupBy("blob", "path").agg(F.collect_set("rule").alias("todo")))
    todo = todo.select(F.col("blob").alias("b"), F.col("path").alias("p"), "todo")
    texts = versions.join(todo, (F.col("blob") == F.col("b")) & F.col("path").eqNullSafe(F.col("p"))).select("blob", "text", "todo")
    return scan(texts, rules)


def findings(ledger: DataFrame, rules=RULES) -> DataFrame:
    """One row per blob with a finding: counts per rule, and its spans."""
    rank = F.coalesce(*[F.when(F.col("rule") == r.name, F.lit(i)) for i, r in enumerate(rules)])
    current = F.lit(False)
    for r in rules:
        current = current | ((F.col("rule") == r.name) & (F.col("rule_version") == r.version))
    spans = F.array_sort(F.collect_list(F.struct("start", rank.alias("rank"), "end", "rule")))
    return (ledger.where(current & F.col("start").isNotNull()).groupBy("blob")
            .agg(spans.alias("s"), *[F.count_if(F.col("rule") == r.name).alias(f"n_{r.name}") for r in rules])
            .select("blob", *[f"n_{r.name}" for r in rules],
                    F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["rule"], x["start"], x["end"])), ",").alias("spans")))


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        return None
    return spark.read.schema(LEDGER).parquet(path)


def scan_secrets(docs: DataFrame, ledger_path: str | None = None, rules=RULES,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_<rule>..., base_sha256, spans)``, one row per document.  The
    ledger at ``ledger_path`` is read and appended to; without one a new ledger
    is made below the shared checkpoint folder."""
    spark = docs.sparkSession
    path = ledger_path or scratch_path(spark, "blob-ledger")
    update_ledger(docs, read_ledger(spark, path), rules, id_col, text_col).write.mode("append").parquet(path)
    # a written table, so that both sides of the join are plain shuffles and a hot blob is split
    found = saved(findings(spark.read.schema(LEDGER).parquet(path), rules), "findings")
    paths = blobs(docs, id_col, text_col).drop("text")
    out = paths.join(found, "blob", "left")
    spans = F.coalesce("spans", F.lit(""))
    return out.select(F.col("path").alias(id_col),
                      *[F.coalesce(f"n_{r.name}", F.lit(0)).cast("long").alias(f"n_{r.name}") for r in rules],
                      F.sha2(spans.cast("binary"), 256).alias("base_sha256"), spans.alias("spans"))
