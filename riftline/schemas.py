"""Column lists and scan schemas of the domain tables."""

from __future__ import annotations

from pyspark.sql import types as T

# The names of the class metrics, in the analyser's order.
METRICS = (
    "cbo cboModified fanin fanout wmc dit noc rfc lcom lcom* tcc lcc totalMethodsQty staticMethodsQty "
    "publicMethodsQty privateMethodsQty protectedMethodsQty defaultMethodsQty visibleMethodsQty "
    "abstractMethodsQty finalMethodsQty synchronizedMethodsQty totalFieldsQty staticFieldsQty "
    "publicFieldsQty privateFieldsQty protectedFieldsQty defaultFieldsQty finalFieldsQty "
    "synchronizedFieldsQty nosi loc returnQty loopQty comparisonsQty tryCatchQty parenthesizedExpsQty "
    "stringLiteralsQty numbersQty assignmentsQty mathOperationsQty variablesQty maxNestedBlocksQty "
    "anonymousClassesQty innerClassesQty lambdasQty uniqueWordsQty modifiers logStatementsQty"
).split()

# Commit facts carried to every class row.
COMMIT_INFO = (
    "fix classification contains_bug entrophy la ld ndev age exp rexp sexp glm_probability "
    "author_date_unix_timestamp"
).split()

# Facts derived from a commit, in the order they are computed.
COMMIT_DERIVED = (
    "time_of_day day_of_week is_weekend net_lines_changed absolute_lines_changed lines_per_file "
    "author_experience author_ownership changed_file_count entropy_bucket num_files_changed"
).split()

# Descriptive columns that are never model features.
INFO = (
    "class type ndev age exp rexp sexp glm_probability time_of_day day_of_week is_weekend "
    "author_experience author_ownership hash file author_date_unix_timestamp"
).split()

# Metrics and commit columns that may be null, and those left out of the main features.
NAN_PRONE = "d_lcom* d_tcc d_lcc lcom* tcc lcc classification".split()
NOT_FEATURES = "lcom* tcc lcc uniqueWordsQty logStatementsQty".split()
COMMIT_FEATURES = "entrophy la ld lines_per_file changed_file_count".split()

LABEL = "contains_bug"


def delta(metric: str) -> str:
    return f"d_{metric}"


def main_features() -> list[str]:
    """The 93 features of the main training run."""
    kept = [m for m in METRICS if m not in NOT_FEATURES]
    return [delta(m) for m in kept] + kept + COMMIT_FEATURES


def change_columns() -> list[str]:
    """The 126 columns of the change table."""
    return (
        [delta(m) for m in METRICS]
        + METRICS
        + ["class", "type"]
        + COMMIT_INFO
        + COMMIT_DERIVED
        + ["hash", "file"]
    )


def quoted(name: str) -> str:
    """A column name as an expression; one metric holds a ``*``."""
    return "`" + name.replace("`", "``") + "`"


COMMITS = T.StructType(
    [
        T.StructField("commit_hash", T.StringType()),
        T.StructField("author_date_unix_timestamp", T.LongType()),
        T.StructField("fileschanged", T.StringType()),
        T.StructField("contains_bug", T.BooleanType()),
        T.StructField("fix", T.BooleanType()),
        T.StructField("classification", T.StringType()),
    ]
    + [
        T.StructField(c, T.DoubleType())
        for c in ("entrophy", "la", "ld", "ndev", "age", "exp", "rexp", "sexp", "glm_probability")
    ]
)

CLASS_METRICS = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("file", "class", "type")]
    + [T.StructField(m, T.DoubleType()) for m in METRICS]
    + [T.StructField("commit", T.StringType())]
)
