"""Domain views over the driver tables (persons, exposures, comorbidities, ...).

They map the star-schema test tables onto the cohort model: customers are persons,
line items are drug exposures (part name, type and size, like a name with a dose),
priorities of finished orders are comorbidities. Each view is a lazy DataFrame; nothing is materialised here.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

# Fixed values of the fixture mapping (must equal the oracle SQL).
GENDER_MOD, OTHER_REMAINDER = 20, 19
DIAGNOSED_STATUS = "F"    # a comorbidity counts once its order is finished
SEVERITY_LEVELS = {"view": 0, "click": 1, "signup": 2, "purchase": 3}
SKIP_SENTINEL = "error"
SCORE_MARKER = "### AUDIT-C Score:"

def exposure_order() -> list:
    """Newest exposure first; the line-item columns make the order total."""
    return [F.col("drug_exposure_start_date").desc(), F.col("concept_name"),
            F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"),
            F.col("l_suppkey"), F.col("l_extendedprice")]


class Tables:
    """Lazy parquet scans of one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._scans: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            # one scan object per table: file listing and footer reads happen once
            if name not in self._scans:
                self._scans[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            return self._scans[name]
        raise AttributeError(name)


class Cohort:
    """The fixture views of FIXTURES.md §B, built with the DataFrame API."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.t = Tables(spark, sf_dir)
        self.spark = spark

    # -- persons -------------------------------------------------------------
    @cached_property
    def persons(self) -> DataFrame:
        c, n, r = self.t.customer, self.t.nation, self.t.region
        key = F.col("c_custkey")
        bal = F.abs(F.col("c_acctbal"))
        # nation/region are fixed-size dimension tables; Catalyst's size statistics
        # pick the broadcast, no hint needed.
        return (c.join(n, c.c_nationkey == n.n_nationkey)
                 .join(r, F.col("n_regionkey") == r.r_regionkey)
                 .select(key.alias("person_id"),
                         F.when(key % GENDER_MOD == OTHER_REMAINDER, "Other")
                          .when(key % 2 == 0, "Man").otherwise("Woman").alias("gender"),
                         F.col("c_mktsegment").alias("race"),
                         F.col("r_name").alias("ethnicity"),
                         (F.lit(18) + key % 70).cast("double").alias("age"),
                         ((key * 7) % 5).cast("int").alias("q1_score"),
                         (F.floor(bal).cast("bigint") % 5).cast("int").alias("q2_score"),
                         (F.floor(bal * 3).cast("bigint") % 5).cast("int").alias("q3_score")))

    @cached_property
    def scored(self) -> DataFrame:
        return self.persons.withColumn(
            "audit_c_score", F.col("q1_score") + F.col("q2_score") + F.col("q3_score"))

    # -- exposures (long) ------------------------------------------------------
    @cached_property
    def exposures(self) -> DataFrame:
        l = (self.t.lineitem
             .select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                     "l_extendedprice", "l_shipdate"))
        o = self.t.orders.select("o_orderkey", "o_custkey")
        p = self.t.part.select("p_partkey", "p_name", "p_type", "p_size")
        return (l.join(o, l.l_orderkey == o.o_orderkey)
                 .join(p, l.l_partkey == p.p_partkey)
                 .select(F.col("o_custkey").alias("person_id"),
                         F.concat_ws(" ", "p_name", "p_type", F.col("p_size").cast("string")).alias("concept_name"),
                         F.col("l_shipdate").cast("date").alias("drug_exposure_start_date"),
                         "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))

    @cached_property
    def como_long(self) -> DataFrame:
        return (self.t.orders
                .filter(F.col("o_orderstatus") == DIAGNOSED_STATUS)
                .select(F.col("o_custkey").alias("person_id"),
                        F.expr("substring(o_orderpriority, 3)").alias("comorbidity"))
                .distinct())

    # -- packed (delimiter-joined) forms of the reference's input files ---------
    @cached_property
    def packed_comorbidity(self) -> DataFrame:
        """person_id, comorbidity (',' packed, sorted). Bounded by the level count per person."""
        return (self.como_long.groupBy("person_id")
                .agg(F.array_join(F.array_sort(F.collect_set("comorbidity")), ",").alias("comorbidity")))

    @cached_property
    def packed_drugs(self) -> DataFrame:
        """A4: person_id, standard_concept_name (' | ' packed distinct names, sorted)."""
        return (self.exposures.groupBy("person_id")
                .agg(F.array_join(F.array_sort(F.collect_set("concept_name")), " | ")
                     .alias("standard_concept_name")))

    @cached_property
    def demo_como(self) -> DataFrame:
        """A1: scored persons with the packed comorbidity column (null when none)."""
        return self.scored.join(self.packed_comorbidity, "person_id", "left").select(
            "person_id", "gender", "race", "ethnicity", "age", "comorbidity",
            "q1_score", "q2_score", "q3_score", "audit_c_score")

    # -- labels / targets ----------------------------------------------------
    @cached_property
    def severity_events(self) -> DataFrame:
        """A5 fatigue/anxiety stand-in: event_type is the raw answer, 'error' the skip sentinel."""
        return self.t.events.select("event_id", F.col("user_id").alias("person_id"), "event_type")

    @cached_property
    def insurance_flags(self) -> DataFrame:
        """A5 insurance stand-in: employer / non-employer flags per person from orders."""
        return (self.t.orders.groupBy(F.col("o_custkey").alias("person_id"))
                .agg(F.max((F.col("o_orderstatus") == "F").cast("int")).alias("empl_merge"),
                     F.max((F.col("o_orderstatus") == "O").cast("int")).alias("non_empl_merge")))

    # -- predictions ---------------------------------------------------------
    @cached_property
    def predictions(self) -> DataFrame:
        """Truth audit_c_score, prediction round(age/8, 1) (ties on purpose), run = ethnicity."""
        return self.scored.select(
            "person_id", F.col("ethnicity").alias("run_id"),
            F.col("audit_c_score").cast("double").alias("label"),
            F.round(F.col("age") / 8, 1).alias("prediction"))

    @cached_property
    def part_predictions(self) -> DataFrame:
        """Per-part truth (q1, q2, q3) and per-part predictions for the fine-grained metrics."""
        return self.scored.select(
            "person_id",
            F.array("q1_score", "q2_score", "q3_score").alias("labels"),
            F.array(F.round(F.col("age") / 25, 1), F.round(F.col("age") / 30, 1),
                    F.round(F.col("age") / 35, 1)).alias("predictions"))

    @cached_property
    def binary_predictions(self) -> DataFrame:
        """M6/M7: quality label as truth, length-based score in [0, 1]."""
        d = self.t.documents.select("doc_id", "n_chars")
        return (self.t.labels.select("doc_id", F.col("quality").alias("label"))
                .join(d, "doc_id")
                .select("doc_id", "label",
                        F.least(F.lit(1.0), F.col("n_chars") / F.lit(5000.0)).alias("score")))

    @cached_property
    def completions(self) -> DataFrame:
        """Generated text per person; every 10th-ish person gets a malformed answer."""
        k = F.col("person_id") % 10
        good = F.concat(F.lit("... " + SCORE_MARKER + " "), F.col("q1_score").cast("string"))
        text = (F.when(k == 1, F.lit("... " + SCORE_MARKER + " text"))
                 .when(k == 2, F.lit(""))
                 .when(k == 3, F.lit("... " + SCORE_MARKER + " 99"))
                 .otherwise(good))
        return self.scored.select("person_id", text.alias("completion"))

    # -- texts / vectors -----------------------------------------------------
    @cached_property
    def texts(self) -> DataFrame:
        return self.t.documents.select("doc_id", "text")

    @cached_property
    def vectors(self) -> DataFrame:
        return self.t.embeddings.select("vec_id", "embedding", "label")
