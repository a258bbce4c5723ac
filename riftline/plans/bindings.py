"""The given tables seen as commits, changes, features and scored rows.

Each view is one SQL text that Spark and the oracle both run: ``{table}`` stands for a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riftline.operators.clean import ROWS_PER_TASK
from riftline.session import ENGINE_CONF

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()
DIMS = [f"e{n:02d}" for n in range(64)]

# Orders as commits: the changed files are listed as text, and a file may be listed but not measured.
COMMITS = """
SELECT CAST(o_orderkey AS STRING) AS hash, o_custkey AS author, o_orderpriority AS project,
       CAST(o_orderdate AS TIMESTAMP) AS author_date, o_orderstatus = 'F' AS contains_bug,
       o_totalprice AS entrophy, f.fileschanged AS fileschanged
FROM {orders}
JOIN (
  SELECT k, '[' || string_agg('''' || p || '''', ', ') || ']' AS fileschanged
  FROM (SELECT DISTINCT l_orderkey AS k, CASE l_returnflag WHEN 'A' THEN 'src/main/A.java'
          WHEN 'R' THEN 'src/main/R.java' ELSE 'src/test/N.java' END AS p FROM {lineitem}) AS d
  GROUP BY k
) AS f ON f.k = o_orderkey
"""

HISTORY = "SELECT -o_orderkey AS seq, CAST(o_orderkey AS STRING) AS hash FROM {orders}"

# Line items as class metrics, unique per commit, file and class.
METRICS = """
SELECT CAST(l_orderkey AS STRING) AS hash,
       CASE l_returnflag WHEN 'A' THEN 'src/main/A.java' WHEN 'R' THEN 'src/main/R.java' ELSE 'src/test/N.java' END AS file,
       l_linestatus AS class,
       CAST(sum(l_quantity) AS DOUBLE) AS loc, CAST(count(*) AS DOUBLE) AS wmc,
       CAST(CASE WHEN max(l_partkey) % 5 = 0 THEN NULL ELSE max(l_linenumber) END AS DOUBLE) AS cbo
FROM {lineitem} GROUP BY l_orderkey, l_returnflag, l_linestatus
"""
METRIC_NAMES = ["loc", "wmc", "cbo"]

# Changes with small whole-number metrics, so that every rule finds rows on both sides; some are null.
CHANGES = """
SELECT o_orderkey AS hash, o_orderpriority AS project, CAST(o_orderdate AS TIMESTAMP) AS author_date_unix_timestamp,
       'src/' || l_returnflag || '/' || CASE pk % 7 WHEN 0 THEN 'UserType' WHEN 1 THEN 'IoException'
          WHEN 2 THEN 'lib-1.0/NodeType' ELSE 'Service' END || '.java' AS file,
       CASE WHEN pk % 11 = 0 THEN NULL ELSE 'C' || CAST(o_custkey AS STRING) || l_linestatus END AS class,
       CASE o_orderstatus WHEN 'P' THEN 'Deleted' ELSE 'class' END AS type,
       CASE WHEN pk % 13 = 0 THEN NULL ELSE o_orderstatus = 'F' END AS contains_bug,
       n % 2 = 0 AS fix, o_custkey AS author, l_linestatus AS part,
       CAST(CASE WHEN pk % 17 = 0 THEN NULL ELSE q % 23 END AS DOUBLE) AS la, CAST((n + ln) % 3 AS DOUBLE) AS ld,
       CAST(CASE WHEN pk % 19 = 0 THEN NULL ELSE 1 + pk % 14 END AS DOUBLE) AS changed_file_count,
       CAST(CASE WHEN pk % 23 = 0 THEN NULL ELSE q % 4 END AS DOUBLE) AS totalMethodsQty,
       CAST(ln % 3 AS DOUBLE) AS totalFieldsQty, CAST(pk % 5 AS DOUBLE) AS wmc, CAST((pk + q) % 4 AS DOUBLE) AS rfc,
       CAST(CASE WHEN pk % 29 = 0 THEN NULL ELSE (q + n) % 4 END AS DOUBLE) AS cbo, CAST(pk % 3 AS DOUBLE) AS fanin,
       CAST(q AS DOUBLE) AS loc, CAST((pk % 3) - 1 AS DOUBLE) AS d_totalMethodsQty,
       CAST((q % 3) - 1 AS DOUBLE) AS d_wmc, CAST((ln % 3) - 1 AS DOUBLE) AS d_loc,
       CAST(CASE WHEN pk % 31 = 0 THEN NULL ELSE ((pk * ln) % 3) - 1 END AS DOUBLE) AS d_cbo,
       o_orderkey * 8 + CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END * 2
          + CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END AS id
FROM (SELECT l_orderkey, l_returnflag, l_linestatus, CAST(sum(l_quantity) AS BIGINT) AS q, count(*) AS n,
             max(l_partkey) AS pk, min(l_linenumber) AS ln
      FROM {lineitem} GROUP BY l_orderkey, l_returnflag, l_linestatus) AS m
JOIN {orders} ON o_orderkey = l_orderkey
"""

# Events as changes of the class ``user_id``; an error deletes the class.
EVENT_CHANGES = """
SELECT event_id AS hash, event_type AS file, user_id AS class, CAST(ts AS TIMESTAMP) AS author_date_unix_timestamp,
       CASE WHEN event_type = 'error' THEN 'DELETED' ELSE event_type END AS type,
       event_type = 'purchase' AS contains_bug, value
FROM {events}
"""

EMBEDDED = (
    "SELECT vec_id AS id, CASE WHEN label = 0 THEN 1 ELSE 0 END AS pos, label, "
    "CAST(embedding AS {doubles}) AS features FROM {embeddings}"
)

SCORED = """
SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, value AS score, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS label,
       CASE WHEN value > 60 THEN 1 ELSE 0 END AS prediction
FROM {events}
"""

# Documents with a label: a few whole-text facts as features.
DOCUMENTS = """
SELECT d.doc_id, l.quality AS label, CAST(n_chars AS DOUBLE) AS chars,
       CAST(length(text) - length(replace(text, ' ', '')) AS DOUBLE) AS spaces,
       CAST(length(text) - length(replace(text, 'e', '')) AS DOUBLE) AS es,
       CAST(length(text) - length(replace(text, ',', '')) AS DOUBLE) AS commas,
       CASE WHEN lang = 'en' THEN 1.0E0 ELSE 0.0E0 END AS english
FROM {documents} AS d JOIN {labels} AS l ON l.doc_id = d.doc_id
"""
DOC_COLS = ["chars", "spaces", "es", "commas", "english"]


class Data:
    """The tables of one folder, and the views over them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        # Timestamps are compared with an oracle that has no zone.
        spark.conf.set("spark.sql.session.timeZone", ENGINE_CONF["spark.sql.session.timeZone"])

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def dealt(self, table: str, by: str) -> DataFrame:
        """A table's rows dealt by a column, to as many tasks as they ask for."""
        rows = getattr(self, table)
        tasks = -(-rows.count() // ROWS_PER_TASK)
        return rows.repartition(tasks, by) if tasks > 1 else rows

    def view(self, text: str, **by: str) -> DataFrame:
        """``by`` names a table's column that the view groups and joins by: dealt by it, the rows move once, and what the
        view makes of them stays where it is."""
        used = {t: self.dealt(t, by[t]) if t in by else getattr(self, t) for t in TABLES if "{" + t + "}" in text}
        if "{doubles}" in text:
            text = text.replace("{doubles}", "ARRAY<DOUBLE>")
        return self.spark.sql(text, **used)

    def features(self) -> DataFrame:
        """Embeddings with one column per dimension."""
        rows = self.view(EMBEDDED)
        return rows.selectExpr("id", "pos", "label", *[f"features[{n}] AS {c}" for n, c in enumerate(DIMS)])

    def indexed_events(self) -> DataFrame:
        return self.view(SCORED)


def oracle_text(text: str) -> str:
    """A view's text for the oracle."""
    names = {t: t for t in TABLES}
    return text.replace("CAST(o_orderkey AS STRING)", "CAST(o_orderkey AS VARCHAR)").format(doubles="DOUBLE[]", **names)
