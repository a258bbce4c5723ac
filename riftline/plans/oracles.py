"""SQL checks of the queries, for a database that has the tables as views."""

from __future__ import annotations

from riftline.plans import bindings as B
from riftline.plans.bindings import DIMS, METRIC_NAMES, oracle_text


def _r(expression: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) + 0.0"


COMMITS, HISTORY = oracle_text(B.COMMITS), oracle_text(B.HISTORY)
METRICS, CHANGES = oracle_text(B.METRICS), oracle_text(B.CHANGES)
EVENT_CHANGES, SCORED = oracle_text(B.EVENT_CHANGES), oracle_text(B.SCORED)
EMBEDDED = oracle_text(B.EMBEDDED)
DELTAS = ["d_totalMethodsQty", "d_wmc", "d_loc", "d_cbo"]
DRAW = "(event_id * 7919 + user_id) % 10007"
DAY = 86400

HOLED = """
SELECT l_orderkey, l_partkey, nullif(max(l_discount), 0.05) AS disc, nullif(max(l_tax), 0.02) AS tax,
       nullif(min(l_returnflag), 'N') AS flag, CASE WHEN sum(l_quantity) > 10 THEN sum(l_quantity) END AS qty,
       CASE WHEN max(l_discount) = 0.05 THEN NULL ELSE max(l_tax) > 0.04 END AS high
FROM lineitem GROUP BY l_orderkey, l_partkey
"""
HOLED_COLS = ["l_orderkey", "l_partkey", "disc", "tax", "flag", "qty", "high"]
HOLES = " + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in HOLED_COLS)


def _sources() -> dict[str, str]:
    return {
        "scan_table": "SELECT * FROM orders",
        "scan_ordered_lines": "SELECT row_number() OVER (ORDER BY o_orderkey DESC) - 1 AS seq, CAST(o_orderkey AS VARCHAR) AS hash FROM orders",
        "scan_keyed_files": """
            SELECT CAST(year(l_shipdate) AS VARCHAR) AS hash, l_returnflag || '/A.java' AS file,
                   CAST(sum(l_quantity) AS DOUBLE) AS loc, count(DISTINCT l_shipdate) AS n
            FROM lineitem GROUP BY 1, 2""",
        "union_tables": """
            SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS o_totalprice,
                   CASE WHEN o_orderstatus = 'F' THEN 'filled' ELSE 'open' END AS project FROM orders""",
        "short_record_filter": "SELECT doc_id, length(text) < 10 AS quarantined FROM documents",
        "write_keyed_table": f"SELECT file, count(*) AS n FROM ({METRICS}) GROUP BY file",
        "write_json_params": """
            SELECT p_brand AS dataset, 'date' AS split, 'depth' AS param, CAST(max(p_size) AS DOUBLE) AS value FROM part GROUP BY p_brand
            UNION ALL SELECT p_brand, 'date', 'rate', min(p_retailprice) FROM part GROUP BY p_brand""",
        "report_side_by_side": _side_by_side(),
        "pending_work": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus <> 'F'",
        "pending_with_parents": """
            WITH done AS (SELECT o_orderkey AS k FROM orders WHERE o_orderpriority = '5-LOW'),
            todo AS (SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'P' AND o_orderkey NOT IN (SELECT k FROM done)),
            every AS (SELECT k FROM todo UNION SELECT max(o.o_orderkey) FROM todo JOIN orders AS o ON o.o_orderkey = todo.k - 1 GROUP BY todo.k)
            SELECT CAST(k AS VARCHAR) AS hash FROM every WHERE k NOT IN (SELECT k FROM done)""",
    }


def _side_by_side() -> str:
    def report(cut: int) -> str:
        return f"""SELECT o_orderpriority AS dataset, CASE WHEN o_orderstatus = 'P' THEN 'accuracy' ELSE o_orderstatus END AS class,
            {_r(f"avg(CASE WHEN o_totalprice > {cut} THEN 1.0E0 ELSE 0.0E0 END)")} AS precision,
            {_r("avg(CASE WHEN o_custkey > 100 THEN 1.0E0 ELSE 0.0E0 END)")} AS recall,
            {_r("max(o_totalprice)", 2)} AS f1, count(*) AS support FROM orders GROUP BY 1, 2"""

    def shown(side: str, name: str) -> str:
        hidden = ", ".join(f"CASE WHEN {side}.class = 'accuracy' THEN NULL ELSE {side}.{c} END AS {name}_{c}" for c in ("precision", "recall"))
        return f"{hidden}, {side}.f1 AS {name}_f1, {side}.support AS {name}_support"

    return f"""
        WITH a AS (SELECT * FROM ({report(100_000)}) WHERE dataset <> '1-URGENT'),
        b AS (SELECT * FROM ({report(200_000)}) WHERE class <> 'O')
        SELECT coalesce(a.dataset, b.dataset) AS dataset, coalesce(a.class, b.class) AS class, {shown('a', 'random')}, {shown('b', 'date')}
        FROM a FULL OUTER JOIN b ON a.dataset = b.dataset AND a.class = b.class"""


def _projections() -> dict[str, str]:
    words = "string_split(p_name, ' ')"
    return {
        "normalize_path": "SELECT page_id, regexp_replace(url, '^https?://[^/]+/', '') AS path FROM pages",
        "split_delimited": f"""
            SELECT p_partkey, array_to_string({words}, '|') AS files, CAST(len({words}) AS INTEGER) AS n,
                   array_to_string({words}, '|') || '|' AS raw_files, CAST(len({words}) + 1 AS INTEGER) AS raw_n FROM part""",
        "parse_list_string": f"SELECT p_partkey, replace(p_name, ' ', '|') AS files, CAST(len({words}) AS INTEGER) AS n FROM part",
        "source_file_filter": """
            SELECT * FROM (SELECT doc_id, source || '/' || lang || CASE WHEN n_chars > 500 THEN '.java' ELSE '.txt' END AS file FROM documents)
            WHERE file LIKE '%.java' AND file NOT LIKE '%es.java' AND file NOT LIKE '%src1%' AND file NOT LIKE '%de%'""",
        "epoch_to_timestamp": "SELECT o_orderkey, to_timestamp(epoch(o_orderdate)) AT TIME ZONE 'UTC' AS at FROM orders",
        "calendar_features": """
            SELECT event_id, CAST(hour(ts) AS INTEGER) AS time_of_day, CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week,
                   isodow(ts) > 5 AS is_weekend FROM events""",
        "churn_features": f"""
            SELECT l_orderkey, sum(l_quantity) - sum(CAST(l_linenumber AS DOUBLE)) AS net_lines_changed,
                   abs(sum(l_quantity) + sum(CAST(l_linenumber AS DOUBLE))) AS absolute_lines_changed,
                   {_r("(sum(l_quantity) + sum(l_linenumber)) / count(*)")} AS lines_per_file
            FROM lineitem GROUP BY l_orderkey""",
        "changed_file_count": """
            SELECT CAST(o_orderkey AS VARCHAR) AS hash, CAST(n AS INTEGER) AS changed_file_count, CAST(n AS INTEGER) AS num_files_changed
            FROM orders JOIN (SELECT l_orderkey, count(DISTINCT l_returnflag) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""",
        "copy_columns": """
            SELECT o_orderkey, o_totalprice AS exp, o_custkey AS ndev, o_totalprice AS author_experience, o_custkey AS author_ownership FROM orders""",
        "equal_width_bucket": """
            WITH s AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part),
            b AS (SELECT p_partkey, CASE WHEN hi = lo THEN 1 WHEN p_retailprice <= lo + (hi - lo) / 3 THEN 0
                    WHEN p_retailprice <= lo + (hi - lo) / 3 * 2 THEN 1 ELSE 2 END AS code FROM part, s)
            SELECT p_partkey, CASE code WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS bucket, CAST(code AS INTEGER) AS code FROM b""",
        "fill_missing": f"""
            SELECT l_orderkey, l_partkey, coalesce(disc, 0.0) AS disc, coalesce(tax, -1.0) AS tax, coalesce(flag, '-1') AS flag,
                   coalesce(qty, -1.0) AS qty, coalesce(high, true) AS high, qty AS kept FROM ({HOLED})""",
        "drop_sparse_rows": f"SELECT * FROM ({HOLED}) WHERE {HOLES} <= 2",
        "null_count_row": f"SELECT l_orderkey, l_partkey, CAST({HOLES} AS INTEGER) AS n_null FROM ({HOLED})",
        "project_columns": "SELECT c_custkey, c_acctbal, c_mktsegment FROM customer",
        "ensure_columns": 'SELECT *, CAST(NULL AS DOUBLE) AS wmc, CAST(NULL AS DOUBLE) AS "lcom*" FROM supplier',
        "sample_fraction": """
            SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (ORDER BY (o_orderkey * 7919 + o_custkey) % 10007, o_orderkey) AS k,
              count(*) OVER () AS n FROM orders) WHERE k <= round(0.1E0 * n)""",
        "limit_rows": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
        "derived_columns": """
            SELECT c_custkey, c_acctbal, c_acctbal < 0 AS debt, abs(c_acctbal) AS size, c_acctbal < 0 AND abs(c_acctbal) > 500 AS both FROM customer""",
    }


FILES = "SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS hash, CASE l_returnflag WHEN 'A' THEN 'src/main/A.java' WHEN 'R' THEN 'src/main/R.java' ELSE 'src/test/N.java' END AS file FROM lineitem"
CHANGED = f"SELECT f.hash, o_custkey AS author, f.file FROM ({FILES}) AS f JOIN orders ON CAST(o_orderkey AS VARCHAR) = f.hash"
FILE_METRICS = """
SELECT CASE l_returnflag WHEN 'A' THEN 'src/main/A.java' WHEN 'R' THEN 'src/main/R.java' ELSE 'src/old/N.java' END AS file,
       l_linestatus AS class, CAST(sum(l_quantity) AS DOUBLE) AS loc, count(*) AS wmc FROM lineitem GROUP BY 1, 2
"""
PARENT = "SELECT CAST(c.o_orderkey AS VARCHAR) AS hash, CAST(p.o_orderkey AS VARCHAR) AS parent FROM orders AS c LEFT JOIN orders AS p ON p.o_orderkey = c.o_orderkey - 1"
CHANGE = ", ".join(f"CASE WHEN p.class IS NOT NULL THEN m.{c} - p.{c} ELSE m.{c} END AS d_{c}" for c in METRIC_NAMES)
NOW = ", ".join(f"m.{c}" for c in METRIC_NAMES)


def _merge(mode: str) -> str:
    info = "c.author, c.project, c.author_date, c.contains_bug, c.entrophy"
    known = "AND EXISTS (SELECT 1 FROM m AS h WHERE h.hash = u.parent AND h.file = u.file)" if mode == "skip" else ""
    gone = ""
    if mode == "zero":
        zeros = ", ".join(f"0.0E0 AS {c}" for c in [*METRIC_NAMES, *[f"d_{m}" for m in METRIC_NAMES]])
        gone = f"""UNION ALL SELECT u.hash, u.parent, u.file, '0' AS class, {zeros}, {info}
            FROM u JOIN c ON c.hash = u.hash WHERE NOT EXISTS (SELECT 1 FROM m AS h WHERE h.hash = u.hash AND h.file = u.file)"""
    return f"""
        WITH m AS ({METRICS}), c AS ({COMMITS}),
        u AS (SELECT f.hash, k.parent, f.file FROM ({FILES}) AS f JOIN ({PARENT}) AS k ON k.hash = f.hash JOIN c ON c.hash = f.hash
              WHERE k.parent IS NOT NULL AND f.file NOT LIKE '%test%' AND f.file LIKE '%.java'
                AND EXISTS (SELECT 1 FROM m WHERE m.hash = k.parent))
        SELECT m.hash, u.parent, m.file, m.class, {NOW}, {CHANGE}, {info}
        FROM u JOIN m ON m.hash = u.hash AND m.file = u.file
        LEFT JOIN m AS p ON p.hash = u.parent AND p.file = m.file AND p.class = m.class
        JOIN c ON c.hash = u.hash
        WHERE true {known} {gone}"""


def _joins() -> dict[str, str]:
    return {
        "explode_inner_join": f"SELECT hash, author, c.file, class, loc, wmc FROM ({CHANGED}) AS c JOIN ({FILE_METRICS}) AS m ON m.file = c.file",
        "explode_left_join": f"SELECT hash, author, m.file, class, loc, wmc FROM ({FILE_METRICS}) AS m LEFT JOIN ({CHANGED}) AS c ON m.file = c.file",
        "changed_class_semi_join": f"""
            SELECT m.* FROM ({METRICS}) AS m WHERE EXISTS (SELECT 1 FROM ({CHANGED}) AS c WHERE c.author > 50 AND c.hash = m.hash AND c.file = m.file)""",
        "class_status": f"""
            WITH m AS (SELECT hash, file, class FROM ({METRICS})),
            p AS (SELECT k.hash, m.file, m.class FROM m JOIN ({PARENT}) AS k ON k.parent = m.hash)
            SELECT coalesce(m.hash, p.hash) AS hash, coalesce(m.file, p.file) AS file, coalesce(m.class, p.class) AS class,
                   CASE WHEN m.hash IS NULL THEN 'deleted' WHEN p.hash IS NULL THEN 'new' ELSE 'modified' END AS status
            FROM m FULL OUTER JOIN p ON p.hash = m.hash AND p.file = m.file AND p.class = m.class""",
        "commit_parent": PARENT,
        "metric_delta": f"""
            WITH m AS ({METRICS})
            SELECT m.*, {CHANGE} FROM m LEFT JOIN (SELECT k.hash AS child, m.* FROM m JOIN ({PARENT}) AS k ON k.parent = m.hash) AS p
              ON p.child = m.hash AND p.file = m.file AND p.class = m.class""",
        "attach_commit_info": f"SELECT m.*, c.author, c.project, c.author_date, c.contains_bug, c.entrophy FROM ({METRICS}) AS m JOIN ({COMMITS}) AS c ON c.hash = m.hash",
        "missing_file_policy": f"""
            WITH f AS ({FILES}), h AS (SELECT DISTINCT hash FROM f),
            p AS (SELECT k.hash, k.parent, n.file FROM ({PARENT}) AS k, (VALUES ('src/main/A.java'), ('src/main/R.java')) AS n(file) WHERE k.parent IS NOT NULL)
            SELECT p.*, true AS held, 'skip' AS mode FROM p JOIN f ON f.hash = p.hash AND f.file = p.file JOIN f AS g ON g.hash = p.parent AND g.file = p.file
            UNION ALL
            SELECT p.*, EXISTS (SELECT 1 FROM f WHERE f.hash = p.hash AND f.file = p.file), 'zero'
            FROM p JOIN h ON h.hash = p.hash JOIN h AS g ON g.hash = p.parent""",
        "merge_changes": _merge("skip"),
        "merge_changes_zero": _merge("zero"),
    }


def _histogram(table: str, column: str, bins: int) -> str:
    return f"""
        WITH t AS (SELECT CAST({column} AS DOUBLE) AS x FROM {table} WHERE {column} IS NOT NULL),
        s AS (SELECT CASE WHEN max(x) = min(x) THEN min(x) - 0.5 ELSE min(x) END AS lo,
                     CASE WHEN max(x) = min(x) THEN 1.0E0 ELSE max(x) - min(x) END / {bins} AS w FROM t),
        c AS (SELECT CAST(least(floor((x - lo) / w), {bins - 1}) AS INTEGER) AS bin, count(*) AS n FROM t, s GROUP BY 1)
        SELECT CAST(b.bin AS INTEGER) AS bin, {_r("lo + w * b.bin")} AS low, {_r("lo + w * (b.bin + 1)")} AS high, coalesce(n, 0) AS n
        FROM range({bins}) AS b(bin) CROSS JOIN s LEFT JOIN c ON c.bin = b.bin"""


def _profiles() -> dict[str, str]:
    size = "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1"
    return {
        "mean_first_by_key": f"""
            WITH f AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_shipdate) AS k FROM lineitem),
            a AS (SELECT l_orderkey, {_r("avg(l_quantity)")} AS l_quantity, {_r("avg(l_extendedprice)")} AS l_extendedprice,
                    max(CASE WHEN k = 1 THEN l_shipdate END) AS l_shipdate, max(CASE WHEN k = 1 THEN l_partkey END) AS l_partkey
                  FROM f GROUP BY l_orderkey)
            SELECT o_orderkey AS l_orderkey, l_quantity, l_extendedprice, l_shipdate, l_partkey FROM orders LEFT JOIN a ON l_orderkey = o_orderkey""",
        "sum_over_count": f"""
            SELECT l_orderkey, {_r("coalesce(sum(nullif(l_quantity, 10.0)), 0) / count(*)")} AS qty, {_r("sum(l_tax) / count(*)")} AS l_tax
            FROM lineitem GROUP BY l_orderkey""",
        "value_counts": "SELECT l_quantity AS qty, count(*) AS count FROM lineitem WHERE l_quantity <> 10 GROUP BY 1",
        "null_profile": f"""
            WITH h AS ({HOLED}), c AS ({" UNION ALL ".join(f"SELECT '{c}' AS column, count(*) - count({c}) AS n_null FROM h" for c in HOLED_COLS)})
            SELECT * FROM c WHERE n_null > 0""".replace("AS column,", 'AS "column",'),
        "distinct_values": f"SELECT DISTINCT disc FROM ({HOLED})",
        "group_size_summary": f"""
            SELECT count(*) AS groups, {_r("avg(n)")} AS mean, {_r("stddev_samp(n)")} AS std, min(n) AS min, {_r("quantile_cont(n, 0.25)")} AS q25,
                   {_r("quantile_cont(n, 0.5)")} AS q50, {_r("quantile_cont(n, 0.75)")} AS q75, max(n) AS max FROM ({size})""",
        "group_size_over": f"""
            WITH s AS (SELECT count(*) AS n FROM lineitem GROUP BY l_suppkey)
            SELECT CAST(l AS INTEGER) AS "limit", count(CASE WHEN n > l THEN 1 END) AS groups, {_r("count(CASE WHEN n > l THEN 1 END) * 100.0E0 / count(*)")} AS percent
            FROM s, (VALUES (100), (620)) AS v(l) GROUP BY l""",
        "top_groups": f"SELECT l_orderkey, n AS size FROM ({size}) ORDER BY n DESC, l_orderkey LIMIT 10",
        "mean_frequency": f"SELECT {_r('avg(n)')} AS mean_frequency FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_partkey)",
        "histogram": _histogram("events", "value", 50),
        "histogram_unchanged": _histogram(
            f"(SELECT * FROM ({CHANGES}) WHERE {' AND '.join(f'{c} = 0' for c in DELTAS)})", "loc", 30
        ),
        "row_count": "SELECT count(*) AS rows FROM lineitem",
    }


TOTAL = " + ".join(f"coalesce(abs({c}), 0)" for c in DELTAS)
STEM = "trim(split_part(file, '.', 1))"
BUG = "coalesce(contains_bug, false)"
# What each rule keeps, as a condition on a row of the change view.
KEEP = {
    "rule_has_members": "totalMethodsQty > 0 OR totalFieldsQty > 0",
    "rule_accessor_only": "NOT coalesce(totalMethodsQty > 0 AND wmc <= 1 AND rfc <= 1, false)",
    "rule_no_lines_added": "la > 0",
    "rule_comment_only": "NOT (" + " AND ".join(f"coalesce({c} = 0, false)" for c in DELTAS) + ")",
    "rule_trivial_method_change": "NOT (coalesce(la + ld < 10, false) AND coalesce(d_totalMethodsQty <> 0, true))",
    "rule_name_suffix": f"{STEM} NOT LIKE '%Type' AND {STEM} NOT LIKE '%Exception'",
    "rule_dead_code": "NOT coalesce(cbo = 0 AND fanin = 0, false)",
    "rule_data_class": "NOT coalesce(wmc <= 1 AND rfc <= 1 AND totalFieldsQty >= 1, false)",
    "rule_no_churn": "NOT coalesce(la = 0 AND ld = 0, false)",
}
OPTIONAL = {
    "rule_change_too_large": f"({TOTAL}) <= 2 OR {BUG}",
    "rule_change_too_small": f"({TOTAL}) >= 2 OR {BUG}",
    "rule_too_many_files": f"changed_file_count <= 7 OR {BUG}",
}


def _recent(table: str, by: str, order: str, gap: float) -> str:
    """Rows of a change table left by the rule on the last clean change of a class."""
    partition = f"PARTITION BY {by}" if by else ""
    inner = ", ".join(c for c in (by, "class") if c)
    return f"""
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {inner} ORDER BY author_date_unix_timestamp DESC, {order}) AS back,
            max(author_date_unix_timestamp) OVER ({partition}) AS ending FROM ({table}))
        WHERE NOT (class IS NOT NULL AND back = 1 AND coalesce(NOT contains_bug, false)
            AND epoch(ending) - epoch(author_date_unix_timestamp) < {gap})"""


def _soon(table: str, by: str, order: str, gap: float) -> str:
    window = f"OVER (PARTITION BY {by} ORDER BY author_date_unix_timestamp, {order})"
    return f"""
        SELECT * FROM (SELECT *, lead(lower(type)) {window} AS next_kind, lead(author_date_unix_timestamp) {window} AS next_time FROM ({table}))
        WHERE NOT (class IS NOT NULL AND coalesce(next_kind = 'deleted' AND epoch(next_time) - epoch(author_date_unix_timestamp) < {gap}, false))"""


def _cleaning() -> dict[str, str]:
    key = "hash, file, class, part"
    out = {n: f"SELECT {key} FROM ({CHANGES}) WHERE {c}" for n, c in {**KEEP, **OPTIONAL}.items()}
    out["rule_dedupe"] = f"SELECT DISTINCT project, type, contains_bug, la, ld, CASE WHEN NOT fix THEN wmc END AS wmc FROM ({CHANGES})"
    down = "hash DESC, file DESC, part DESC"
    out["rule_recent_clean_last"] = f"SELECT {key} FROM ({_recent(CHANGES, 'project', down, 600 * DAY)})"
    out["rule_deleted_soon"] = f"SELECT {key} FROM ({_soon(CHANGES, 'project, class', 'hash, file, part', 40 * DAY)})"
    out["rule_recent_clean_last_events"] = f"SELECT hash, class, file FROM ({_recent(EVENT_CHANGES, '', 'hash DESC', 6 * 3600)})"
    out["rule_deleted_soon_events"] = f"SELECT hash, class, file FROM ({_soon(EVENT_CHANGES, 'class', 'hash', 6 * 3600)})"
    deduped = f"SELECT DISTINCT * FROM ({CHANGES})"
    chain = f"SELECT * FROM ({_recent(deduped, 'project', down, 200 * DAY)}) WHERE " + " AND ".join(f"({c})" for c in KEEP.values())
    out["clean_dataset"] = f"SELECT {key}, project FROM ({chain})"
    out["clean_features_labels"] = f"SELECT id, la, ld, wmc, cbo, contains_bug FROM ({chain})"
    last = _recent(deduped, "project", down, 200 * DAY)
    stages = [("NULL", CHANGES), ("0", deduped), ("2", last)]
    numbers = [3, 4, 5, 6, 7, 8, 9, 10, 11]
    for n in range(len(KEEP)):
        held = " AND ".join(f"({c})" for c in list(KEEP.values())[: n + 1])
        stages.append((str(numbers[n]), f"SELECT * FROM ({last}) WHERE {held}"))
    counts = " UNION ALL ".join(f"SELECT {n} AS step, CAST({r} AS INTEGER) AS rule, count(*) AS rows FROM ({t})" for n, (r, t) in enumerate(stages))
    out["clean_counts"] = f"""
        SELECT CAST(step AS INTEGER) AS step, rule, rows, lag(rows) OVER (ORDER BY step) - rows AS dropped FROM ({counts})"""
    first = "arg_min({c}, id)"
    out["cluster_aggregate"] = f"""
        SELECT project, author, min(id) AS id, {first.format(c="file")} AS file, {_r("avg(wmc)")} AS wmc, {_r("avg(rfc)")} AS rfc,
               avg(CASE WHEN contains_bug THEN 1.0E0 WHEN NOT contains_bug THEN 0.0E0 END) >= 0.5 AS contains_bug,
               {_r("avg(CASE WHEN fix THEN 1.0E0 ELSE 0.0E0 END)")} AS fix, {_r("avg(la)")} AS la
        FROM ({CHANGES}) GROUP BY project, author, totalFieldsQty"""
    return out


def _scaled(low: str, width: str) -> str:
    names = ["loc", "rfc", "ld", "flat"]
    stats = ", ".join(f"{low.format(c=c)} AS a_{c}, {width.format(c=c)} AS b_{c}" for c in names)
    values = ", ".join(_r(f"({c} - a_{c}) / CASE WHEN b_{c} = 0 THEN 1 ELSE b_{c} END") + f" AS {c}" for c in names)
    return f"""
        WITH t AS (SELECT id, loc, rfc, ld, 7.0E0 AS flat,
            row_number() OVER (ORDER BY author_date_unix_timestamp, id) - 1 >= CAST(floor((1 - 0.2E0) * count(*) OVER ()) AS BIGINT) AS is_test
            FROM ({CHANGES})),
        s AS (SELECT {stats} FROM t WHERE NOT is_test)
        SELECT id, is_test, {values} FROM t, s"""


def _splits() -> dict[str, str]:
    ordered = f"(SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS i FROM ({SCORED}))"
    frame = "ORDER BY i ROWS BETWEEN 24 PRECEDING AND CURRENT ROW"
    return {
        "split_random": f"""
            SELECT event_id, row_number() OVER (ORDER BY {DRAW}, event_id) <= ceil(0.2E0 * count(*) OVER ()) AS is_test FROM events""",
        "split_by_date": """
            SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 >= CAST(floor((1 - 0.2E0) * count(*) OVER ()) AS BIGINT) AS is_test
            FROM orders""",
        "minmax_scale": _scaled("min({c})", "max({c}) - min({c})"),
        "standard_scale": _scaled("avg({c})", "stddev_pop({c})"),
        "sliding_windows": f"""
            SELECT i, label, 25 AS n, first, last, total FROM (
              SELECT i, label, first_value(score) OVER ({frame}) AS first, score AS last,
                     {_r(f"sum(score * (1 + prediction)) OVER ({frame})", 4)} AS total FROM {ordered})
            WHERE i >= 24""",
        "sliding_windows_by_group": f"""
            SELECT user_id, i, label, total FROM (
              SELECT user_id, event_type AS label, row_number() OVER w - 1 AS i,
                     {_r("sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)", 4)} AS total
              FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE i >= 4""",
        "balanced_class_weights": f"""
            SELECT o_orderstatus, n, {_r("sum(n) OVER () / (CAST(count(*) OVER () AS DOUBLE) * n)")} AS weight
            FROM (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1)""",
        "pos_weight_ratio": f"SELECT {_r('count(CASE WHEN quality = 0 THEN 1 END) / CAST(count(CASE WHEN quality = 1 THEN 1 END) AS DOUBLE)')} AS ratio FROM labels",
        "stratified_folds": f"SELECT event_id, CAST((row_number() OVER (PARTITION BY event_type ORDER BY {DRAW}, event_id) - 1) % 5 AS INTEGER) AS fold FROM events",
        "expanding_folds": f"""
            WITH t AS (SELECT event_id, i, (SELECT count(*) FROM events) // 6 AS s FROM {ordered}),
            f AS (SELECT event_id, i, s, CAST(fold AS INTEGER) AS fold FROM t, range(5) AS r(fold))
            SELECT event_id, i, fold, CASE WHEN i < (fold + 1) * s THEN 'train' ELSE 'test' END AS role FROM f WHERE i < (fold + 2) * s""",
    }


NEAR = f"""
    e AS MATERIALIZED ({EMBEDDED}),
    g AS MATERIALIZED (SELECT a.id, b.id AS neighbour, a.pos, b.pos AS other, list_distance(a.features, b.features) AS distance
          FROM e AS a JOIN e AS b ON a.id <> b.id),
    k AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, neighbour) AS rank FROM g)
"""


def _resampling() -> dict[str, str]:
    return {
        "undersample": f"""
            WITH c AS (SELECT min(n) AS least FROM (SELECT count(*) AS n FROM events GROUP BY event_type))
            SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY {DRAW}, event_id) AS k FROM events), c WHERE k <= least""",
        "knn_join": f"WITH {NEAR} SELECT id, CAST(rank AS INTEGER) AS rank, neighbour, {_r('distance')} AS distance FROM k WHERE rank <= 5",
        "tomek_links": f"""
            WITH {NEAR}, n AS (SELECT * FROM k WHERE rank = 1)
            SELECT id, pos FROM e WHERE id NOT IN
              (SELECT a.id FROM n AS a JOIN n AS b ON b.id = a.neighbour AND b.neighbour = a.id WHERE a.pos <> a.other AND a.pos = 0)""",
        "edited_nn": f"WITH {NEAR} SELECT id, pos FROM e WHERE id NOT IN (SELECT id FROM k WHERE rank <= 3 AND pos = 0 AND other <> pos)",
    }


def _long(columns: list[str], extra: str = "pos, label", source: str | None = None) -> str:
    """Feature table in long form: position, name and value."""
    if source is None:
        return f"SELECT id, {extra}, UNNEST(range(64)) AS j, UNNEST(features) AS x FROM ({EMBEDDED})"
    return " UNION ALL ".join(f"SELECT {extra}, {n} AS j, CAST({c} AS DOUBLE) AS x FROM {source}" for n, c in enumerate(columns))


NAME = "'e' || lpad(CAST({} AS VARCHAR), 2, '0')"


def _anova(long: str, label: str) -> str:
    """``j, score``: the F statistic from centred class sums."""
    return f"""
        SELECT j, CASE WHEN q - e > 1e-12 * q THEN ((e - s * s / n) / (k - 1)) / ((q - e) / (n - k)) END AS score FROM (
          SELECT j, sum(n) AS n, sum(s) AS s, sum(q) AS q, sum(s * s / n) AS e, count(*) AS k FROM (
            SELECT j, {label}, CAST(count(x) AS DOUBLE) AS n, sum(x - m) AS s, sum((x - m) * (x - m)) AS q
            FROM (SELECT *, avg(x) OVER (PARTITION BY j) AS m FROM ({long})) GROUP BY j, {label}) GROUP BY j)"""


def _mrmr(k: int) -> str:
    """The greedy choice unrolled: one pair of steps per chosen feature."""
    parts = [
        f"t AS MATERIALIZED ({_long(DIMS)})",
        f"f AS MATERIALIZED ({_anova('SELECT * FROM t', 'pos')})",
        "r AS MATERIALIZED (SELECT a.j, b.j AS o, abs(corr(a.x, b.x)) AS r FROM t AS a JOIN t AS b ON a.id = b.id AND a.j <> b.j GROUP BY a.j, b.j)",
        "s1 AS MATERIALIZED (SELECT j, score, 1 AS rank FROM f ORDER BY score DESC, j LIMIT 1)",
    ]
    for n in range(2, k + 1):
        parts.append(
            f"s{n} AS MATERIALIZED (SELECT * FROM s{n - 1} UNION ALL SELECT * FROM (SELECT f.j, f.score / greatest(avg(r.r), 1e-3) AS score, {n} AS rank "
            f"FROM f JOIN r ON r.j = f.j WHERE r.o IN (SELECT j FROM s{n - 1}) AND f.j NOT IN (SELECT j FROM s{n - 1}) "
            f"GROUP BY f.j, f.score ORDER BY 2 DESC, f.j LIMIT 1))"
        )
    return f"WITH {', '.join(parts)} SELECT {NAME.format('j')} AS feature, {_r('score', 4)} AS score, CAST(rank AS INTEGER) AS rank FROM s{k}"


def _selection() -> dict[str, str]:
    top = "SELECT {name} AS feature, {score} AS score, CAST(row_number() OVER (ORDER BY {by} DESC NULLS LAST, j) AS INTEGER) AS rank FROM ({rows}) ORDER BY rank LIMIT 10"
    holed = f"""SELECT id, j, CASE WHEN j = 63 THEN 1.0E0 WHEN j = 0 AND NOT (features[2] < 0.1) THEN NULL ELSE x END AS x
        FROM (SELECT id, features, UNNEST(range(64)) AS j, UNNEST(features) AS x FROM ({EMBEDDED}))"""
    chi = f"""
        SELECT j, sum((s - share * t) * (s - share * t) / (share * t)) AS score FROM (
          SELECT j, s, n / sum(n) OVER (PARTITION BY j) AS share, sum(s) OVER (PARTITION BY j) AS t FROM (
            SELECT j, l_returnflag, CAST(count(*) AS DOUBLE) AS n, sum(x) AS s
            FROM ({_long(["l_quantity", "l_linenumber", "l_discount", "l_tax"], "l_returnflag", "lineitem")}) GROUP BY 1, 2)) GROUP BY j"""
    pairs = "t AS MATERIALIZED ({rows}), p AS (SELECT a.j AS i, b.j, corr(a.x, b.x) AS r FROM t AS a JOIN t AS b ON a.id = b.id AND a.j < b.j {where} GROUP BY 1, 2)"
    return {
        "label_correlation": top.format(name=NAME.format("j"), score=_r("score"), by="abs(score)", rows=f"SELECT j, corr(x, pos) AS score FROM ({_long(DIMS)}) GROUP BY j"),
        "anova_f": top.format(name=NAME.format("j"), score=_r("score"), by="score", rows=_anova(_long(DIMS), "label")),
        "chi2_score": top.format(name="['l_quantity', 'l_linenumber', 'l_discount', 'l_tax'][j + 1]", score=_r("score"), by="score", rows=chi),
        "correlation_matrix": f"""
            WITH {pairs.format(rows=holed, where="WHERE a.x IS NOT NULL AND b.x IS NOT NULL")}
            SELECT {NAME.format("i")} AS a, {NAME.format("j")} AS b, CASE WHEN j <> 63 THEN {_r("r")} END AS r FROM p""",
        "select_cbfs": f"""
            WITH {pairs.format(rows=_long(DIMS), where="")}
            SELECT {NAME.format("j")} AS feature FROM range(64) AS a(j) WHERE j NOT IN (SELECT j FROM p WHERE abs(r) > 0.12)""",
        "select_mrmr": _mrmr(5),
        "drop_constant": "SELECT 'l_tax' AS feature UNION ALL SELECT 'l_linenumber' UNION ALL SELECT 'l_returnflag'",
    }


def _bayes(learned: str) -> str:
    """Every refit of the naive Bayes model by running sums over the test rows."""
    sums = []
    for part in (0, 1):
        sums.append(f"CASE WHEN label = {part} THEN 1.0E0 ELSE 0.0E0 END AS n{part}")
        for x in ("x0", "x1"):
            sums.append(f"CASE WHEN label = {part} THEN {x} ELSE 0.0E0 END AS s{part}_{x}")
            sums.append(f"CASE WHEN label = {part} THEN {x} * {x} ELSE 0.0E0 END AS q{part}_{x}")
    names = [s.split(" AS ")[1] for s in sums]
    running = ", ".join(f"sum({n}) OVER (ORDER BY i) AS {n}" for n in names)
    start = ", ".join(f"sum({n}) AS {n}" for n in names)
    model = ", ".join(f"coalesce(p.{n}, 0) + s.{n} AS {n}" for n in names)

    def density(part: int) -> str:
        terms = [f"ln(n{part} / (n0 + n1))"]
        for x in ("x0", "x1"):
            mean = f"(s{part}_{x} / n{part})"
            spread = f"(q{part}_{x} / n{part} - {mean} * {mean} + floor_)"
            terms.append(f"-0.5 * (ln(2 * pi() * {spread}) + ({x} - {mean}) * ({x} - {mean}) / {spread})")
        return " + ".join(terms)

    return f"""
        WITH e AS (SELECT event_id, ts, ln(1 + value) AS r0, hour(ts) / 24.0E0 AS r1, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS label,
              row_number() OVER (ORDER BY ts, event_id) - 1 AS place, CAST(floor((1 - 0.2E0) * count(*) OVER ()) AS BIGINT) AS cut FROM events),
        m AS (SELECT avg(r0) AS m0, avg(r1) AS m1, 1e-9 * greatest(var_pop(r0), var_pop(r1)) AS floor_ FROM e WHERE place < cut),
        t AS (SELECT place - cut AS i, label, r0 - m0 AS x0, r1 - m1 AS x1, floor_ FROM e, m),
        v AS (SELECT i, label, {", ".join(sums)} FROM t),
        s AS (SELECT {start} FROM v WHERE i < 0),
        p AS (SELECT i + 1 AS learned, {running} FROM v WHERE i >= 0),
        l AS (SELECT i, label, x0, x1, floor_, CAST({learned} AS BIGINT) AS learned FROM t WHERE i >= 0),
        w AS (SELECT l.*, {model} FROM l CROSS JOIN s LEFT JOIN p ON p.learned = l.learned)
        SELECT i, learned, label, {_r(f"1 / (1 + exp(({density(0)}) - ({density(1)})))")} AS score FROM w"""


def _online() -> dict[str, str]:
    ordered = f"(SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS i FROM ({SCORED}))"
    each = "CASE WHEN i < 150 THEN 0 ELSE i - 150 + 1 END"
    batched = "CASE WHEN i < 150 THEN 0 ELSE (i - 150) // 50 * 50 END"
    return {
        "label_delay_schedule": f"""
            SELECT event_id, i, CAST({each} AS BIGINT) AS each, CAST({batched} AS BIGINT) AS batched, greatest(0, i - 150) AS after_predict FROM {ordered}""",
        "online_retrain_each": _bayes(each),
        "online_retrain_batched": _bayes(batched),
        "delayed_label_join": f"""
            SELECT i + 150 AS i, i AS made_at, prediction, label, prediction = label AS correct FROM {ordered}
            WHERE i + 150 < (SELECT count(*) FROM events)""",
        "delayed_label_stream": """
            SELECT event_id, CASE WHEN value > 60 THEN 1 ELSE 0 END AS prediction, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS label,
                   ts + INTERVAL 5 HOUR AS labelled_at FROM events""",
        "predict_threshold": "SELECT event_id, CASE WHEN value / (value + 50) > 0.5 THEN 1 ELSE 0 END AS prediction FROM events",
    }


def _evaluation() -> dict[str, str]:
    by_score = f"SELECT score, sum(label) AS pos, count(*) - sum(label) AS neg FROM ({SCORED}) GROUP BY score"
    cells = {f"{a}{b}": f"count(CASE WHEN label = {a} AND prediction = {b} THEN 1 END) AS n{a}{b}" for a in (0, 1) for b in (0, 1)}
    counts = f"SELECT {', '.join(cells.values())} FROM ({SCORED})"
    per = "coalesce(CAST({t} AS DOUBLE) / nullif({d}, 0), 0)"
    p = {c: per.format(t=f"n{c}{c}", d=f"n0{c} + n1{c}") for c in (0, 1)}
    r = {c: per.format(t=f"n{c}{c}", d=f"n{c}0 + n{c}1") for c in (0, 1)}
    scores = ", ".join(f"{p[c]} AS p{c}, {r[c]} AS r{c}, n{c}0 + n{c}1 AS s{c}" for c in (0, 1))
    f = {c: f"coalesce(2 * p{c} * r{c} / nullif(p{c} + r{c}, 0), 0)" for c in (0, 1)}
    n = "s0 + s1"
    right = f"CAST(n00 + n11 AS DOUBLE) / ({n})"

    def row(name: str, a: str, b: str, c: str, support: str) -> str:
        return f"SELECT '{name}' AS class, {_r(a)} AS precision, {_r(b)} AS recall, {_r(c)} AS f1, {support} AS support FROM t"

    def mean(x: str, y: str) -> str:
        return f"({x} + {y}) / 2"

    def weigh(x: str, y: str) -> str:
        return f"({x} * s0 + {y} * s1) / ({n})"

    report = [row(str(c), f"p{c}", f"r{c}", f"f{c}", f"s{c}") for c in (0, 1)]
    report.append(row("accuracy", right, right, right, n))
    report.append(row("macro avg", mean("p0", "p1"), mean("r0", "r1"), mean("f0", "f1"), n))
    report.append(row("weighted avg", weigh("p0", "p1"), weigh("r0", "r1"), weigh("f0", "f1"), n))
    return {
        "confusion_matrix": f"WITH c AS ({counts}) " + " UNION ALL ".join(
            f"SELECT {a} AS label, {b} AS prediction, n{a}{b} AS n FROM c" for a in (0, 1) for b in (0, 1)
        ),
        "classification_report": f"WITH c AS ({counts}), u AS (SELECT *, {scores} FROM c), t AS (SELECT *, {f[0]} AS f0, {f[1]} AS f1 FROM u) "
        + " UNION ALL ".join(report),
        "accuracy": f"SELECT {_r('avg(CASE WHEN label = prediction THEN 1.0E0 ELSE 0.0E0 END)')} AS accuracy FROM ({SCORED})",
        "average_precision": f"""
            WITH s AS ({by_score}), c AS (SELECT pos, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM s WINDOW w AS (ORDER BY score DESC))
            SELECT {_r("sum(CAST(pos AS DOUBLE) * tp / (tp + fp)) / sum(pos)")} AS average_precision FROM c""",
        "roc_auc": f"""
            WITH s AS ({by_score}), c AS (SELECT pos, neg, sum(pos + neg) OVER (ORDER BY score) - (pos + neg - 1) / 2.0E0 AS rank FROM s)
            SELECT {_r("(sum(pos * rank) - CAST(sum(pos) AS DOUBLE) * (sum(pos) + 1) / 2) / (CAST(sum(pos) AS DOUBLE) * sum(neg))")} AS roc_auc FROM c""",
        "prediction_timeline": f"SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS i, label = prediction AS correct FROM ({SCORED})",
        "mean_abs_attribution": f"SELECT l_returnflag AS feature, {_r('avg(abs(l_quantity - 25))')} AS mean_abs FROM lineitem GROUP BY 1",
    }


def oracles() -> dict[str, str]:
    parts = (
        _sources, _projections, _joins, _profiles, _cleaning, _splits, _resampling, _selection, _online, _evaluation,
    )
    return {name: text for part in parts for name, text in part().items()}
