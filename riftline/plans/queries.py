"""One query per operator, over the whole given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riftline import schemas
from riftline.functions import columns as C
from riftline.functions.folds import col
from riftline.operators import clean, evaluate, explain, joins, models, online, profile, resample, rows, scale, select, split
from riftline.operators.clusters import cluster_aggregate, rule_cluster_reduce
from riftline.operators.neighbours import knn_join
from riftline.operators.ordering import with_global_index
from riftline.plans import bindings as B
from riftline.plans.bindings import DIMS, DOC_COLS, METRIC_NAMES, Data
from riftline.plans.changes import build_changes, merge_changes
from riftline.plans.training import RunConfig, train_evaluate
from riftline.session import ensure_checkpoint_dir, freeze
from riftline.sources import tables as S
from riftline.streaming.live import LiveLogistic, delayed_label_stream

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(function: Callable[[Data], DataFrame]) -> Callable[[Data], DataFrame]:
    REGISTRY[function.__name__] = lambda spark, folder: function(Data(spark, folder))
    return function


def scratch(data: Data, name: str) -> str:
    """A new folder beside the checkpoints, which every executor can reach."""
    return f"{ensure_checkpoint_dir(data.spark)}/riftline-{name}-{uuid.uuid4().hex}"


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(col(n), digits) for n in names})


def at(name: str):
    return F.col(name).cast("timestamp")


# ---------------------------------------------------------------- scans and sinks

@query
def scan_table(d: Data) -> DataFrame:
    path = scratch(d, "orders")
    S.write_table(d.orders.withColumn("o_orderdate", at("o_orderdate")), path)
    schema = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"
    return S.scan_table(d.spark, path, schema)


@query
def scan_ordered_lines(d: Data) -> DataFrame:
    path = scratch(d, "history")
    keys = d.orders.orderBy(F.desc("o_orderkey")).select(F.col("o_orderkey").cast("string"))
    keys.write.text(path)
    return S.scan_ordered_lines(d.spark, path)


@query
def scan_keyed_files(d: Data) -> DataFrame:
    path = scratch(d, "metrics")
    table = d.lineitem.groupBy("l_shipdate", "l_returnflag").agg(F.sum("l_quantity").alias("loc")).select(
        F.concat(F.lit("/work_3/"), "l_returnflag", F.lit("\\A.java")).alias("file"), "loc",
        F.year("l_shipdate").cast("string").alias("hash"),
    )
    S.write_keyed_table(table, path, key="hash", fmt="csv")
    found = S.scan_keyed_files(d.spark, path, schema="file string, loc double", prefix="^/work_[0-9]+/")
    return found.groupBy("hash", "file").agg(F.sum("loc").alias("loc"), F.count(F.lit(1)).alias("n"))


@query
def union_tables(d: Data) -> DataFrame:
    named = {
        "filled": d.orders.filter("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice"),
        "open": d.orders.filter("o_orderstatus <> 'F'").select("o_orderkey"),
    }
    return S.union_tables(named)


@query
def short_record_filter(d: Data) -> DataFrame:
    return S.short_record_filter(d.documents.select("doc_id", "text"), col="text").select("doc_id", "quarantined")


@query
def write_keyed_table(d: Data) -> DataFrame:
    path = scratch(d, "keyed")
    S.write_keyed_table(d.view(B.METRICS).withColumn("lines", F.col("class")), path, key="file")
    return d.spark.read.parquet(path).groupBy("file").agg(F.count(F.lit(1)).alias("n"))


@query
def write_json_params(d: Data) -> DataFrame:
    path = scratch(d, "params")
    top = d.part.groupBy("p_brand").agg(F.max("p_size").alias("depth"), F.min("p_retailprice").alias("rate"))
    tidy = top.unpivot(["p_brand"], [F.col("depth").cast("double").alias("depth"), "rate"], "param", "value").select(
        F.col("p_brand").alias("dataset"), F.lit("date").alias("split"), "param", "value"
    )
    S.write_json_params(tidy, path)
    return d.spark.read.json(path)


def _status_report(d: Data, cut: float) -> DataFrame:
    return d.orders.groupBy(F.col("o_orderpriority").alias("dataset"), F.col("o_orderstatus").alias("class")).agg(
        F.round(F.avg((F.col("o_totalprice") > cut).cast("double")), 6).alias("precision"),
        F.round(F.avg((F.col("o_custkey") > 100).cast("double")), 6).alias("recall"),
        F.round(F.max("o_totalprice"), 2).alias("f1"), F.count(F.lit(1)).alias("support"),
    ).withColumn("class", F.when(F.col("class") == "P", "accuracy").otherwise(F.col("class")))


@query
def report_side_by_side(d: Data) -> DataFrame:
    left = _status_report(d, 100_000).filter("dataset <> '1-URGENT'")
    right = _status_report(d, 200_000).filter("class <> 'O'")
    return S.report_side_by_side(left, right)


@query
def pending_work(d: Data) -> DataFrame:
    done = d.orders.filter("o_orderstatus = 'F'").select("o_orderkey")
    return S.pending_work(d.orders.select("o_orderkey", "o_custkey"), done, key="o_orderkey")


@query
def pending_with_parents(d: Data) -> DataFrame:
    todo = d.orders.filter("o_orderstatus = 'P'").select(F.col("o_orderkey").cast("string").alias("hash"))
    done = d.orders.filter("o_orderpriority = '5-LOW'").select(F.col("o_orderkey").cast("string").alias("hash"))
    parents = joins.commit_parent(d.view(B.HISTORY)).drop("seq")
    return S.pending_with_parents(todo, parents, done, key="hash")


# ---------------------------------------------------------------- projections and filters

@query
def normalize_path(d: Data) -> DataFrame:
    raw = F.replace(F.col("url"), F.lit("/"), F.lit("\\"))
    path = C.normalize_path(raw, prefix=r"^https?:\\\\[^\\]+\\")
    return d.pages.select("page_id", path.alias("path"))


def _listed(sep: str):
    """Two words of a part as a delimited list with stray commas."""
    return F.concat(F.lit(","), F.replace("p_name", F.lit(" "), F.lit(sep)), F.lit(sep + "," + sep))


@query
def split_delimited(d: Data) -> DataFrame:
    sep = "CAS_DELIMITER"
    kept = C.split_delimited(_listed(sep), sep=sep)
    raw = C.split_delimited(_listed(sep), sep=sep, drop_empty=False)
    return d.part.select(
        "p_partkey", F.array_join(kept, "|").alias("files"), F.size(kept).alias("n"),
        F.array_join(raw, "|").alias("raw_files"), F.size(raw).alias("raw_n"),
    )


@query
def parse_list_string(d: Data) -> DataFrame:
    text = F.concat(F.lit("['"), F.replace("p_name", F.lit(" "), F.lit("', '")), F.lit("']"))
    files = C.parse_list_string(text)
    return d.part.select("p_partkey", F.array_join(files, "|").alias("files"), F.size(files).alias("n"))


@query
def source_file_filter(d: Data) -> DataFrame:
    path = F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.when(F.col("n_chars") > 500, ".java").otherwise(".txt"))
    docs = d.documents.select("doc_id", path.alias("file"))
    return rows.source_file_filter(docs, col="file", banned=("src1", "de"), excluded=("es.java",))


@query
def epoch_to_timestamp(d: Data) -> DataFrame:
    return d.orders.select("o_orderkey", C.epoch_to_timestamp(F.unix_timestamp(at("o_orderdate"))).alias("at"))


@query
def calendar_features(d: Data) -> DataFrame:
    return d.events.select("event_id", *[c.alias(n) for n, c in C.calendar_features(at("ts")).items()])


@query
def churn_features(d: Data) -> DataFrame:
    per_order = d.lineitem.groupBy("l_orderkey").agg(
        F.sum("l_quantity").alias("la"), F.sum(F.col("l_linenumber").cast("double")).alias("ld"),
        F.count(F.lit(1)).alias("files"),
    )
    new = C.churn_features(added=F.col("la"), deleted=F.col("ld"), files=F.col("files"))
    return rounded(per_order.select("l_orderkey", *[c.alias(n) for n, c in new.items()]), "lines_per_file")


@query
def changed_file_count(d: Data) -> DataFrame:
    count = C.changed_file_count(F.col("fileschanged"))
    return d.view(B.COMMITS).select("hash", count.alias("changed_file_count"), count.alias("num_files_changed"))


@query
def copy_columns(d: Data) -> DataFrame:
    named = d.orders.select("o_orderkey", F.col("o_totalprice").alias("exp"), F.col("o_custkey").alias("ndev"))
    return rows.copy_columns(named, {"author_experience": "exp", "author_ownership": "ndev"})


@query
def equal_width_bucket(d: Data) -> DataFrame:
    return rows.equal_width_bucket(
        d.part.select("p_partkey", "p_retailprice"), col="p_retailprice", out="bucket"
    ).select("p_partkey", "bucket", C.ordinal(F.col("bucket"), {"low": 0, "medium": 1, "high": 2}).alias("code"))


def _holed(d: Data) -> DataFrame:
    """Line items with holes, counted per order and part."""
    return d.lineitem.groupBy("l_orderkey", "l_partkey").agg(
        F.sum("l_quantity").alias("qty"), F.max("l_discount").alias("disc"), F.min("l_returnflag").alias("flag"),
        F.max("l_tax").alias("tax"),
    ).select(
        "l_orderkey", "l_partkey", F.nullif("disc", F.lit(0.05)).alias("disc"), F.nullif("tax", F.lit(0.02)).alias("tax"),
        F.nullif("flag", F.lit("N")).alias("flag"), F.when(F.col("qty") > 10, F.col("qty")).alias("qty"),
        F.when(F.col("disc") == 0.05, F.lit(None)).otherwise(F.col("tax") > 0.04).alias("high"),
    )


@query
def fill_missing(d: Data) -> DataFrame:
    named = rows.fill_missing(_holed(d).withColumn("kept", F.col("qty")), 0, cols=["disc"])
    return rows.fill_missing(named, -1, cols=["tax", "flag", "qty", "high"])


@query
def drop_sparse_rows(d: Data) -> DataFrame:
    return rows.drop_sparse_rows(_holed(d), max_nulls=2)


@query
def null_count_row(d: Data) -> DataFrame:
    return rows.null_count_row(_holed(d)).select("l_orderkey", "l_partkey", "n_null")


@query
def project_columns(d: Data) -> DataFrame:
    return rows.project_columns(d.customer, drop=["c_name", "c_nationkey"])


@query
def ensure_columns(d: Data) -> DataFrame:
    return rows.ensure_columns(d.supplier, ["s_acctbal", "wmc", "lcom*"])


@query
def sample_fraction(d: Data) -> DataFrame:
    drawn = d.orders.select("o_orderkey", "o_custkey", F.pmod(F.col("o_orderkey") * 7919 + F.col("o_custkey"), F.lit(10007)).alias("draw"))
    return rows.sample_fraction(drawn, key="o_orderkey", fraction=0.1, draw="draw").drop("draw")


@query
def limit_rows(d: Data) -> DataFrame:
    return rows.limit_rows(d.orders.select("o_orderkey", "o_totalprice"), order=[F.desc("o_totalprice"), "o_orderkey"], n=10)


@query
def derived_columns(d: Data) -> DataFrame:
    return rows.derived_columns(
        d.customer.select("c_custkey", "c_acctbal"),
        {"debt": lambda t: t["c_acctbal"] < 0, "size": lambda t: F.abs(t["c_acctbal"]), "both": lambda t: t["debt"] & (t["size"] > 500)},
    )


# ---------------------------------------------------------------- joins

def _commit_files(d: Data) -> DataFrame:
    return d.view(B.COMMITS).select("hash", "author", C.parse_list_string(F.col("fileschanged")).alias("files"))


def _file_metrics(d: Data) -> DataFrame:
    """Metrics per customer's file: as many rows as customers and flags."""
    return d.lineitem.groupBy(
        F.when(F.col("l_returnflag") == "A", "src/main/A.java").when(F.col("l_returnflag") == "R", "src/main/R.java")
        .otherwise("src/old/N.java").alias("file"), F.col("l_linestatus").alias("class"),
    ).agg(F.sum("l_quantity").alias("loc"), F.count(F.lit(1)).alias("wmc"))


@query
def explode_inner_join(d: Data) -> DataFrame:
    return joins.explode_inner_join(_commit_files(d), _file_metrics(d), files="files", file="file").select(
        "hash", "author", "file", "class", "loc", "wmc"
    )


@query
def explode_left_join(d: Data) -> DataFrame:
    return joins.explode_left_join(_commit_files(d), _file_metrics(d), files="files", file="file").select(
        "hash", "author", "file", "class", "loc", "wmc"
    )


@query
def changed_class_semi_join(d: Data) -> DataFrame:
    changed = joins.explode_files(_commit_files(d).filter(F.col("author") > 50), files="files", file="file")
    return joins.changed_class_semi_join(d.view(B.METRICS), changed, on=["hash", "file"])


def _parents(d: Data) -> DataFrame:
    """Class metrics of each commit's parent, under the commit's own key."""
    older = joins.commit_parent(d.view(B.HISTORY)).select(F.col("hash").alias("child"), F.col("parent").alias("hash"))
    return d.view(B.METRICS).join(older.filter("hash IS NOT NULL"), "hash").drop("hash").withColumnRenamed("child", "hash")


@query
def class_status(d: Data) -> DataFrame:
    return joins.class_status(d.view(B.METRICS), _parents(d), keys=["hash", "file", "class"], include_deleted=True)


@query
def commit_parent(d: Data) -> DataFrame:
    return joins.commit_parent(d.view(B.HISTORY)).select("hash", "parent")


@query
def metric_delta(d: Data) -> DataFrame:
    return joins.metric_delta(d.view(B.METRICS), _parents(d), keys=["hash", "file", "class"], metrics=METRIC_NAMES)


@query
def attach_commit_info(d: Data) -> DataFrame:
    commits = d.view(B.COMMITS).drop("fileschanged")
    twice = commits.unionByName(commits.withColumn("entrophy", F.col("entrophy") + 1.0))
    return joins.attach_commit_info(
        d.view(B.METRICS), twice, key="hash", order=["entrophy", "author", "project"]
    )


def _pairs(d: Data) -> DataFrame:
    parents = joins.commit_parent(d.view(B.HISTORY)).filter("parent IS NOT NULL").select("hash", "parent")
    every = F.array(F.lit("src/main/A.java"), F.lit("src/main/R.java"))
    return parents.select("hash", "parent", F.explode(every).alias("file"))


@query
def missing_file_policy(d: Data) -> DataFrame:
    metrics, pairs = d.view(B.METRICS), _pairs(d)
    skip = joins.missing_file_policy(pairs, metrics, mode="skip").withColumn("mode", F.lit("skip"))
    zero = joins.missing_file_policy(pairs, metrics, mode="zero").withColumn("mode", F.lit("zero"))
    return skip.unionByName(zero)


def _merged(d: Data, mode: str) -> DataFrame:
    return merge_changes(
        d.view(B.COMMITS), d.view(B.HISTORY), d.view(B.METRICS), metric_names=METRIC_NAMES, missing_file=mode, unique=True
    )


@query
def merge_changes_skip(d: Data) -> DataFrame:
    return _merged(d, "skip")


REGISTRY["merge_changes"] = REGISTRY.pop("merge_changes_skip")


@query
def merge_changes_zero(d: Data) -> DataFrame:
    return _merged(d, "zero")


@query
def change_table_full(d: Data) -> DataFrame:
    """The 126 columns from raw commits and class metrics."""
    commits = d.view(B.COMMITS).select(
        F.col("hash").alias("commit_hash"), F.unix_seconds("author_date").alias("author_date_unix_timestamp"), "fileschanged",
        "contains_bug", (F.col("author") % 2 == 0).alias("fix"), F.lit(None).cast("string").alias("classification"), "entrophy",
        *[(F.col("author") % n).cast("double").alias(c) for n, c in enumerate(("la", "ld", "ndev", "age", "exp", "rexp", "sexp", "glm_probability"), 11)],
    )
    metrics = d.view(B.METRICS).select(
        F.col("hash").alias("commit"), "file", "class", F.lit("class").alias("type"),
        *[F.pmod(F.col("loc") + n * F.col("wmc"), F.lit(float(7 + n))).alias(m) for n, m in enumerate(schemas.METRICS)],
    )
    return build_changes(commits, d.view(B.HISTORY), metrics, unique=True)


# ---------------------------------------------------------------- profiles

@query
def mean_first_by_key(d: Data) -> DataFrame:
    table = profile.mean_first_by_key(
        d.lineitem, key=["l_orderkey"], numeric=["l_quantity", "l_extendedprice"], other=["l_shipdate", "l_partkey"],
        order=["l_linenumber", "l_partkey", "l_shipdate"],
    )
    every = d.orders.select(F.col("o_orderkey").alias("l_orderkey")).join(table, "l_orderkey", "left")
    return rounded(every.withColumn("l_shipdate", at("l_shipdate")), "l_quantity", "l_extendedprice")


@query
def sum_over_count(d: Data) -> DataFrame:
    holed = d.lineitem.select("l_orderkey", F.nullif("l_quantity", F.lit(10.0)).alias("qty"), "l_tax")
    return rounded(profile.sum_over_count(holed, key=["l_orderkey"], cols=["qty", "l_tax"]), "qty", "l_tax")


@query
def value_counts(d: Data) -> DataFrame:
    return profile.value_counts(d.lineitem.select(F.nullif("l_quantity", F.lit(10.0)).alias("qty")), col="qty")


@query
def null_profile(d: Data) -> DataFrame:
    return profile.null_profile(_holed(d))


@query
def distinct_values(d: Data) -> DataFrame:
    return profile.distinct_values(_holed(d), col="disc")


@query
def group_size_summary(d: Data) -> DataFrame:
    return rounded(profile.group_size_summary(d.lineitem, key=["l_orderkey"]), "mean", "std", "q25", "q50", "q75")


@query
def group_size_over(d: Data) -> DataFrame:
    return rounded(profile.group_size_over(d.lineitem, key=["l_suppkey"], limits=(100, 620)), "percent")


@query
def top_groups(d: Data) -> DataFrame:
    return profile.top_groups(d.lineitem, key=["l_orderkey"])


@query
def mean_frequency(d: Data) -> DataFrame:
    return rounded(profile.mean_frequency(d.lineitem, col="l_partkey"), "mean_frequency")


@query
def histogram(d: Data) -> DataFrame:
    return rounded(profile.histogram(d.events, col="value", bins=50), "low", "high")


@query
def histogram_unchanged(d: Data) -> DataFrame:
    """Only the rows whose metric changes are all zero."""
    changes = d.view(B.CHANGES)
    still = F.lit(True)
    for name in [c for c in changes.columns if c.startswith("d_")]:
        still = still & F.coalesce(col(name) == 0, F.lit(False))
    return rounded(profile.histogram(changes, col="loc", bins=30, where=still), "low", "high")


@query
def row_count(d: Data) -> DataFrame:
    return profile.row_count(d.lineitem)


# ---------------------------------------------------------------- cleaning

KEY = ["hash", "file", "class"]
TIMED = {"project": "project", "tie": ["hash", "file", "part"]}


def _rule(name: str, apply: Callable[[DataFrame], DataFrame]) -> None:
    REGISTRY[name] = lambda spark, folder: apply(Data(spark, folder).view(B.CHANGES)).select(*KEY, "part")


@query
def rule_dedupe(d: Data) -> DataFrame:
    shown = d.view(B.CHANGES).select(
        "project", "type", "contains_bug", "la", "ld", F.when(F.col("fix"), F.lit(float("nan"))).otherwise(F.col("wmc")).alias("wmc")
    )
    return clean.rule_dedupe(shown)


_rule("rule_deleted_soon", lambda t: clean.rule_deleted_soon(t, gap=40 * clean.DAY, **TIMED))
_rule("rule_recent_clean_last", lambda t: clean.rule_recent_clean_last(t, gap=600 * clean.DAY, **TIMED))
_rule("rule_has_members", clean.rule_has_members)
_rule("rule_accessor_only", clean.rule_accessor_only)
_rule("rule_no_lines_added", clean.rule_no_lines_added)
_rule("rule_comment_only", clean.rule_comment_only)
_rule("rule_trivial_method_change", clean.rule_trivial_method_change)
_rule("rule_name_suffix", clean.rule_name_suffix)
_rule("rule_dead_code", clean.rule_dead_code)
_rule("rule_data_class", clean.rule_data_class)
_rule("rule_no_churn", clean.rule_no_churn)
_rule("rule_change_too_large", lambda t: clean.rule_change_too_large(t, threshold=2))
_rule("rule_change_too_small", lambda t: clean.rule_change_too_small(t, threshold=2))
_rule("rule_too_many_files", lambda t: clean.rule_too_many_files(t, threshold=7))


@query
def rule_deleted_soon_events(d: Data) -> DataFrame:
    kept = clean.rule_deleted_soon(d.view(B.EVENT_CHANGES), gap=6 * 3600, tie=["hash"])
    return kept.select("hash", "class", "file")


@query
def rule_recent_clean_last_events(d: Data) -> DataFrame:
    kept = clean.rule_recent_clean_last(d.view(B.EVENT_CHANGES), gap=6 * 3600, tie=["hash"])
    return kept.select("hash", "class", "file")


CLUSTERED = ["wmc", "rfc", "loc", "totalMethodsQty", "d_wmc", "d_loc"]
CLEAN = clean.CleanConfig(
    rules=(0, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11), project="project", tie=("hash", "file", "part"), gap_recent=200 * clean.DAY
)


@query
def rule_cluster_reduce_(d: Data) -> DataFrame:
    """Customers stand for commits, as they have many rows."""
    changes = d.view(B.CHANGES).withColumnRenamed("hash", "order").withColumnRenamed("author", "hash")
    return rule_cluster_reduce(
        changes, threshold=10, features=CLUSTERED, info=["order", "file", "class", "type", "part", "id"],
        tie=["id"], project="project",
    )


REGISTRY["rule_cluster_reduce"] = REGISTRY.pop("rule_cluster_reduce_")


@query
def cluster_aggregate_(d: Data) -> DataFrame:
    changes = d.view(B.CHANGES).select(
        "project", "author", F.col("totalFieldsQty").cast("int").alias("cluster"), "id", "file", "wmc", "rfc", "contains_bug", "fix", "la"
    )
    out = cluster_aggregate(
        changes, keys=["project", "author"], cluster="cluster", features=["wmc", "rfc"], info=["id", "file"], order=["id"]
    )
    return rounded(out, "wmc", "rfc", "fix", "la")


REGISTRY["cluster_aggregate"] = REGISTRY.pop("cluster_aggregate_")


@query
def clean_dataset(d: Data) -> DataFrame:
    return clean.clean_dataset(d.view(B.CHANGES), config=CLEAN).select(*KEY, "part", "project")


@query
def clean_counts(d: Data) -> DataFrame:
    # Equal changes have one order, so they share its task.
    return clean.clean_counts(d.view(B.CHANGES, lineitem="l_orderkey"), config=CLEAN, dealt=True)


@query
def clean_features_labels(d: Data) -> DataFrame:
    return clean.clean_features_labels(
        d.view(B.CHANGES), features=["id", "la", "ld", "wmc", "cbo"], config=CLEAN
    )


# ---------------------------------------------------------------- splits, scaling, windows

@query
def split_random(d: Data) -> DataFrame:
    drawn = d.events.withColumn("draw", F.pmod(F.col("event_id") * 7919 + F.col("user_id"), F.lit(10007)))
    return split.split_random(drawn, key="event_id", draw="draw").select("event_id", "is_test")


@query
def split_by_date(d: Data) -> DataFrame:
    return split.split_by_date(d.orders, ts="o_orderdate", tie="o_orderkey").select("o_orderkey", "is_test")


def _dated_changes(d: Data) -> tuple[DataFrame, DataFrame]:
    # The view is read in several passes, and computing it is the costly part.
    changes = freeze(
        d.view(B.CHANGES).select("id", "author_date_unix_timestamp", "loc", "rfc", "ld", F.lit(7.0).alias("flat"))
    )
    dated = split.split_by_date(changes, ts="author_date_unix_timestamp", tie="id")
    return dated.filter("NOT is_test"), dated.filter("is_test")


def _scaled(d: Data, scaler) -> DataFrame:
    names = ["loc", "rfc", "ld", "flat"]
    train, test = scaler(*_dated_changes(d), cols=names)
    return rounded(train.unionByName(test).select("id", "is_test", *names), *names)


@query
def minmax_scale(d: Data) -> DataFrame:
    return _scaled(d, scale.minmax_scale)


@query
def standard_scale(d: Data) -> DataFrame:
    return _scaled(d, scale.standard_scale)


@query
def sliding_windows(d: Data) -> DataFrame:
    runs = split.sliding_windows(
        d.view(B.SCORED), order=["ts", "event_id"], cols=["score", "prediction"], label="label", size=25, block=1000
    )
    return runs.select(
        "i", "label", F.size("sequence").alias("n"), F.element_at("sequence", 1)[0].alias("first"),
        F.element_at("sequence", -1)[0].alias("last"),
        F.round(F.aggregate("sequence", F.lit(0.0), lambda a, r: a + r[0] * (1 + r[1])), 4).alias("total"),
    )


@query
def sliding_windows_by_group(d: Data) -> DataFrame:
    runs = split.sliding_windows(
        d.events.select("event_id", at("ts").alias("ts"), "user_id", "value", F.col("event_type").alias("kind")),
        order=["ts", "event_id"], cols=["value"], label="kind", size=5, by="user_id",
    )
    return runs.select(
        "user_id", "i", "label", F.round(F.aggregate("sequence", F.lit(0.0), lambda a, r: a + r[0]), 4).alias("total")
    )


@query
def balanced_class_weights(d: Data) -> DataFrame:
    return rounded(split.balanced_class_weights(d.orders, label="o_orderstatus"), "weight")


@query
def pos_weight_ratio(d: Data) -> DataFrame:
    return rounded(split.pos_weight_ratio(d.labels, label="quality"), "ratio")


@query
def stratified_folds(d: Data) -> DataFrame:
    drawn = d.events.withColumn("draw", F.pmod(F.col("event_id") * 7919 + F.col("user_id"), F.lit(10007)))
    return split.stratified_folds(drawn, label="event_type", key="event_id", draw="draw").select("event_id", "fold")


@query
def expanding_folds(d: Data) -> DataFrame:
    return split.expanding_folds(d.view(B.SCORED).select("event_id", "ts"), order=["ts", "event_id"]).select(
        "event_id", "i", "fold", "role"
    )


# ---------------------------------------------------------------- resampling

RARE = {"key": "id", "cols": DIMS, "label": "pos"}


@query
def undersample(d: Data) -> DataFrame:
    drawn = d.events.withColumn("draw", F.pmod(F.col("event_id") * 7919 + F.col("user_id"), F.lit(10007)))
    return resample.undersample(drawn, key="event_id", label="event_type", draw="draw").select("event_id", "event_type")


@query
def smote(d: Data) -> DataFrame:
    return resample.smote(d.features(), **RARE)


@query
def adasyn(d: Data) -> DataFrame:
    return resample.adasyn(d.features(), **RARE)


@query
def tomek_links(d: Data) -> DataFrame:
    return resample.tomek_links(d.features(), **RARE).select("id", "pos")


@query
def edited_nn(d: Data) -> DataFrame:
    return resample.edited_nn(d.features(), **RARE).select("id", "pos")


@query
def knn_join_(d: Data) -> DataFrame:
    points = d.view(B.EMBEDDED).select("id", "features")
    return rounded(knn_join(points, points, k=5, exclude_self=True), "distance")


REGISTRY["knn_join"] = REGISTRY.pop("knn_join_")


# ---------------------------------------------------------------- feature selection

SCORED_BY = {"cols": DIMS, "label": "pos"}


@query
def label_correlation(d: Data) -> DataFrame:
    return rounded(select.label_correlation(d.features(), **SCORED_BY), "score")


@query
def correlation_matrix(d: Data) -> DataFrame:
    holed = d.features().withColumn("e00", F.when(F.col("e01") < 0.1, F.col("e00"))).withColumn("e63", F.lit(1.0))
    return rounded(select.correlation_matrix(holed, cols=DIMS).select("a", "b", "r"), "r")


@query
def select_cbfs(d: Data) -> DataFrame:
    return select.select_cbfs(d.features(), cols=DIMS, threshold=0.12).select("feature")


@query
def select_mrmr(d: Data) -> DataFrame:
    return rounded(select.select_mrmr(d.features(), k=5, **SCORED_BY), "score", digits=4)


@query
def anova_f(d: Data) -> DataFrame:
    return rounded(select.anova_f(d.features(), cols=DIMS, label="label"), "score")


CHI_COLS = ["l_quantity", "l_linenumber", "l_discount", "l_tax"]


@query
def chi2_score(d: Data) -> DataFrame:
    return rounded(select.chi2_score(d.lineitem, cols=CHI_COLS, label="l_returnflag"), "score")


@query
def tree_importance(d: Data) -> DataFrame:
    return select.tree_importance(d.features(), **SCORED_BY)


@query
def select_model_threshold(d: Data) -> DataFrame:
    return select.select_model_threshold(d.features(), maxIter=5, **SCORED_BY)


@query
def select_rfe(d: Data) -> DataFrame:
    return select.select_rfe(d.view(B.DOCUMENTS), cols=DOC_COLS, label="label", k=2)


@query
def select_l1(d: Data) -> DataFrame:
    return select.select_l1(d.features(), **SCORED_BY)


@query
def drop_constant(d: Data) -> DataFrame:
    table = d.lineitem.withColumns({"flat": F.lit(3), "none": F.lit(None).cast("int")})
    kept = select.drop_constant(table, cols=["l_tax", "flat", "none", "l_linenumber", "l_returnflag"])
    return d.spark.createDataFrame([(c,) for c in kept], "feature string")


@query
def pca_project(d: Data) -> DataFrame:
    rows_ = split.split_random(d.features(), key="id")
    train, test = rows_.filter("NOT is_test"), rows_.filter("is_test")
    a, b = select.pca_project(train, test, cols=DIMS, k=50)
    return a.unionByName(b).select("id", "is_test", F.col("pc")[0].alias("pc0"), F.col("pc")[1].alias("pc1"))


# ---------------------------------------------------------------- models

DOCS = {"cols": DOC_COLS, "label": "label"}


def _fitted(d: Data, fit: Callable, **params) -> DataFrame:
    table = split.with_class_weight(d.view(B.DOCUMENTS), label="label").persist()
    marked = split.split_random(table, key="doc_id")
    model = fit(marked.filter("NOT is_test"), **DOCS, **params)
    return model.score(marked).select("doc_id", "label", "is_test", "score", "prediction")


@query
def fit_logistic(d: Data) -> DataFrame:
    return _fitted(d, models.fit_logistic, weight="weight")


@query
def fit_random_forest(d: Data) -> DataFrame:
    return _fitted(d, models.fit_random_forest, weight="weight", numTrees=100)


@query
def fit_boosted_trees(d: Data) -> DataFrame:
    return _fitted(d, models.fit_boosted_trees, pos_weight=2.0, n_estimators=10, learning_rate=0.13, gamma=0.0003,
                   subsample=0.99, colsample_bytree=0.68, reg_alpha=6e-6, reg_lambda=1e-4)


@query
def fit_mlp(d: Data) -> DataFrame:
    return _fitted(d, models.fit_mlp, hidden=(100, 50))


@query
def fit_balanced_forest(d: Data) -> DataFrame:
    return _fitted(d, models.fit_balanced_forest, key="doc_id")


@query
def predict_threshold(d: Data) -> DataFrame:
    return models.predict_threshold(
        d.events.select("event_id", (F.col("value") / (F.col("value") + 50)).alias("p")), score="p"
    ).select("event_id", "prediction")


@query
def tune_cv(d: Data) -> DataFrame:
    space = {"n_estimators": models._whole(3, 6), "max_depth": models._whole(2, 4), "learning_rate": models._log(0.05, 0.3)}
    found = models.tune_cv(
        d.view(B.DOCUMENTS), key="doc_id", folds=3, trials=2, space=space, parallelism=4, **DOCS
    )
    rows_ = [(n, name, float(v), float(s)) for n, (p, s) in enumerate(found.trials) for name, v in p.items()]
    return d.spark.createDataFrame(rows_, "trial int, param string, value double, score double")


@query
def train_evaluate_projects(d: Data) -> DataFrame:
    features = ["la", "ld", "wmc", "rfc", "cbo", "loc", "d_wmc", "d_loc", "d_totalMethodsQty"]
    config = RunConfig(
        features=features, model="logistic", folds=2, trials=1, n_features=4, delay=100, frequency=500,
        space={"regParam": models._log(0.001, 0.1), "maxIter": models._whole(20, 20)},
        clean=clean.CleanConfig(
            project="project", tie=("hash", "file", "part"), features=features,
            info=["id", "file", "class", "type", "part", "author_date_unix_timestamp", "author"],
        ),
    )
    changes = d.view(B.CHANGES).withColumn("project", F.col("part"))
    return train_evaluate(changes, config=config).report


# ---------------------------------------------------------------- delayed labels

TIMELINE = ["ts", "event_id"]


@query
def label_delay_schedule(d: Data) -> DataFrame:
    indexed = with_global_index(d.view(B.SCORED).select("ts", "event_id"), TIMELINE)
    modes = {"each": (150, 1), "batched": (150, 50), "after_predict": (150, 1)}
    return indexed.select(
        "event_id", "i",
        *[online.learned_before(F.col("i"), delay=n, frequency=f, mode=m).alias(m) for m, (n, f) in modes.items()],
    )


def _stream_rows(d: Data) -> tuple[DataFrame, DataFrame]:
    """Events in time order with two facts; a purchase is the label."""
    table = d.events.select(
        "event_id", at("ts").alias("ts"), F.log1p("value").alias("x0"), (F.hour(at("ts")) / 24.0).alias("x1"),
        F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("label"),
    )
    marked = split.split_by_date(table, ts="ts", tie="event_id")
    return marked.filter("NOT is_test"), marked.filter("is_test")


ONLINE = {"order": TIMELINE, "cols": ["x0", "x1"], "label": "label", "delay": 150}


@query
def online_retrain_each(d: Data) -> DataFrame:
    return rounded(online.online_retrain_bayes(*_stream_rows(d), mode="each", **ONLINE), "score").drop("prediction")


@query
def online_retrain_batched(d: Data) -> DataFrame:
    done = online.online_retrain_bayes(*_stream_rows(d), mode="batched", frequency=50, **ONLINE)
    return rounded(done, "score").drop("prediction")


@query
def online_incremental(d: Data) -> DataFrame:
    return online.online_incremental(*_stream_rows(d), batch=250, **ONLINE)


@query
def online_incremental_batched(d: Data) -> DataFrame:
    return online.online_incremental_batched(*_stream_rows(d), frequency=250, **ONLINE)


@query
def online_incremental_stream(d: Data) -> DataFrame:
    """The same model kept up to date by a stream of the test rows."""
    train, test = _stream_rows(d)
    folder = scratch(d, "live")
    test.drop("is_test").repartitionByRange(4, "ts").sortWithinPartitions("ts").write.option("maxRecordsPerFile", 2000).parquet(f"{folder}/in")
    start = online.initial_weights(train, cols=ONLINE["cols"], label="label")
    live = LiveLogistic(folder, cols=ONLINE["cols"], label="label", start=start)
    schema = d.spark.read.parquet(f"{folder}/in").schema
    stream = d.spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    live.run(stream, checkpoint=f"{folder}/checkpoint").awaitTermination()
    return live.scored(d.spark).select("event_id", "label", "score", "prediction", "batch")


@query
def prequential_logistic(d: Data) -> DataFrame:
    train, test = _stream_rows(d)
    return online.prequential_logistic(
        train.unionByName(test), order=TIMELINE, cols=["x0", "x1"], label="label", batch=500
    )


@query
def delayed_label_join(d: Data) -> DataFrame:
    return online.delayed_label_join(d.view(B.SCORED), order=TIMELINE, delay=150)


@query
def delayed_label_stream_(d: Data) -> DataFrame:
    """Predictions and their labels, five hours later, as two streams."""
    folder = scratch(d, "labels")
    d.events.select("event_id", at("ts").alias("ts"), (F.col("value") > 60).cast("int").alias("prediction")).write.parquet(f"{folder}/made")
    d.events.select(
        "event_id", (at("ts") + F.expr("interval 5 hours")).alias("labelled_at"),
        (F.col("event_type") == "purchase").cast("int").alias("label"),
    ).write.parquet(f"{folder}/known")

    def stream(name: str) -> DataFrame:
        path = f"{folder}/{name}"
        return d.spark.readStream.schema(d.spark.read.parquet(path).schema).parquet(path)

    joined = delayed_label_stream(
        stream("made"), stream("known"), key="event_id", predicted_at="ts", labelled_at="labelled_at"
    )
    joined.writeStream.format("parquet").option("path", f"{folder}/out").option(
        "checkpointLocation", f"{folder}/checkpoint"
    ).trigger(availableNow=True).start().awaitTermination()
    return d.spark.read.parquet(f"{folder}/out").select("event_id", "prediction", "label", "labelled_at")


REGISTRY["delayed_label_stream"] = REGISTRY.pop("delayed_label_stream_")


# ---------------------------------------------------------------- evaluation

@query
def confusion_matrix(d: Data) -> DataFrame:
    return evaluate.confusion_matrix(d.view(B.SCORED))


@query
def classification_report(d: Data) -> DataFrame:
    return rounded(evaluate.classification_report(d.view(B.SCORED)), "precision", "recall", "f1")


@query
def accuracy(d: Data) -> DataFrame:
    return rounded(evaluate.accuracy(d.view(B.SCORED)), "accuracy")


@query
def average_precision(d: Data) -> DataFrame:
    return rounded(evaluate.average_precision(d.view(B.SCORED)), "average_precision")


@query
def roc_auc(d: Data) -> DataFrame:
    return rounded(evaluate.roc_auc(d.view(B.SCORED)), "roc_auc")


@query
def prediction_timeline(d: Data) -> DataFrame:
    return evaluate.prediction_timeline(with_global_index(d.view(B.SCORED), TIMELINE))


# ---------------------------------------------------------------- explanations

def _explained(d: Data) -> tuple[models.Fitted, DataFrame]:
    table = d.view(B.DOCUMENTS)
    return models.fit_boosted_trees(table, maxIter=5, maxDepth=3, **DOCS), table


@query
def permutation_importance(d: Data) -> DataFrame:
    model, table = _explained(d)
    return explain.permutation_importance(model, table, key="doc_id", **DOCS)


@query
def partial_dependence(d: Data) -> DataFrame:
    model, table = _explained(d)
    return explain.partial_dependence(model, table, cols=DOC_COLS)


@query
def local_surrogate(d: Data) -> DataFrame:
    model, table = _explained(d)
    return explain.local_surrogate(model, table, cols=DOC_COLS, key="doc_id", train=table)


def _attributed(d: Data) -> DataFrame:
    model, table = _explained(d)
    return explain.tree_shapley_values(model, table, key="doc_id")


@query
def shapley_values(d: Data) -> DataFrame:
    return _attributed(d)


@query
def mean_abs_attribution(d: Data) -> DataFrame:
    values = d.lineitem.select(
        F.col("l_returnflag").alias("feature"), (F.col("l_quantity") - 25).alias("value")
    )
    return rounded(explain.mean_abs_attribution(values), "mean_abs")

