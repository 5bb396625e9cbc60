"""Operator 5: secret scan with corpus-wide ownership frequency.

Candidates (key formats and assigned values) are extracted with one regular expression over whole texts and hashed; per hash
the distinct repositories and owners are counted over the whole corpus. A candidate that many repositories of several owners
carry is a widely copied example; one of few distinct characters or with a tell-tale word is a placeholder; what
remains with one or a few owners looks live.

``repo_col`` and ``owner_col`` name the columns that stand for repository and owner (here a document is its own repository and
its source the owner). Only candidates are shuffled, never texts, except that ``redact`` joins verdicts back to documents.

Defined cases: null and empty texts hold no candidates; a null owner or repository isn't counted; a value that occurs twice in a
document is reported once for it; rows with a null doc_id are reported with the null, and ``redact`` treats each of their
candidates as live; a text of any length is searched whole; of values of which one holds the other, the longer is replaced first; of forms that match at one
place the first in PATTERN counts; a count equal to min_owners or min_repos reaches it; repeated rows count once per distinct
repository; empty tables give no rows; other columns pass through ``redact``. Assigned values of fewer than 16 characters are no candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

PATTERN = (
    r"""(?:[Tt]oken|TOKEN|[Ss]ecret|SECRET|[Pp]assword|PASSWORD|[Aa]pi_?[Kk]ey|API_?KEY|[Aa]ccess_?[Kk]ey|ACCESS_?KEY)["']?[ \t]*(?::=|=>|[=:])[ \t]*["']?[A-Za-z0-9_/+-]{16,}"""
    r"|AKIA[0-9A-Z]{16}|AIza[A-Za-z0-9_-]{35}|gh[opsu]_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{22,}|sk-(?:proj|svcacct|or-v1|ant-api[0-9]{2})-[A-Za-z0-9_-]{16,}|sk-[A-Za-z0-9]{20,}|[rs]k_live_[A-Za-z0-9]{16,}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}|-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*"
)
#: What stands before an assigned value.
ASSIGNED = r"""^[A-Za-z_]+["']?[ \t]*(?::=|=>|[=:])[ \t]*["']?"""
TELLTALE = "example|placeholder|changeme|your|dummy|xxxx|0123456789|1234567890|abcdef0123"


def _kind(match: Column) -> Column:
    return (
        F.when(match.rlike(ASSIGNED), "assignment").when(match.rlike("^(AKIA|AIza)"), "cloud_key").when(match.rlike("^(gh._|github)"), "forge_token").when(match.rlike("^[rs]k[-_]"), "api_key").when(match.startswith("xox"), "chat_token").when(match.startswith("eyJ"), "signed_token").otherwise("private_key")
    )


def candidates(docs: DataFrame, repo_col: str = "doc_id", owner_col: str = "source") -> DataFrame:
    """(doc_id, repo, owner, kind, value), once per document and value."""
    found = F.explode(F.array_distinct(F.expr(f"regexp_extract_all(text, r'{PATTERN.replace(chr(39), '\\x27')}', 0)")))
    return (
        docs.select("doc_id", F.col(repo_col).alias("repo"), F.col(owner_col).alias("owner"), found.alias("match"))
        .select("doc_id", "repo", "owner", _kind(F.col("match")).alias("kind"), F.regexp_replace("match", ASSIGNED, "").alias("value"))
        .dropDuplicates()
    )


def judged(found: DataFrame, min_owners: int = 3, min_repos: int = 5, min_distinct: int = 8) -> DataFrame:
    """(secret_hash, n_repos, n_owners, verdict) of each distinct candidate."""
    placeholder = (F.size(F.array_distinct(F.split("value", ""))) < min_distinct) & (F.col("kind") != "private_key") | F.lower("value").rlike(TELLTALE)
    counted = found.groupBy("value", "kind").agg(F.countDistinct("repo").alias("n_repos"), F.countDistinct("owner").alias("n_owners"))
    verdict = F.when(placeholder, "placeholder").when((F.col("n_owners") >= min_owners) & (F.col("n_repos") >= min_repos), "example").otherwise("live")
    return counted.select("value", "kind", F.sha2("value", 256).alias("secret_hash"), "n_repos", "n_owners", verdict.alias("verdict"))


def scan(docs: DataFrame, repo_col: str = "doc_id", owner_col: str = "source", min_owners: int = 3, min_repos: int = 5, min_distinct: int = 8) -> DataFrame:
    """(doc_id, secret_hash, kind, n_repos, n_owners, verdict); the values themselves are not returned."""
    found = common.materialise(candidates(docs, repo_col, owner_col))
    verdicts = judged(found, min_owners, min_repos, min_distinct)
    return found.select("doc_id", "value", "kind").distinct().join(verdicts, ["value", "kind"]).select("doc_id", "secret_hash", "kind", "n_repos", "n_owners", "verdict")


def redact(docs: DataFrame, repo_col: str = "doc_id", owner_col: str = "source", mark: str = "[SECRET]", **limits: int) -> DataFrame:
    """docs with every live-looking credential replaced by mark; all columns, no row lost. n_chars, if there, follows the text."""
    found = common.materialise(candidates(docs, repo_col, owner_col))
    live = judged(found, **limits).filter("verdict = 'live'").select("value", "kind")
    owned = found.filter("doc_id is not null").join(live, ["value", "kind"]).groupBy("doc_id").agg(F.collect_set(F.struct((-F.length("value")).alias("n"), "value")).alias("live"))
    # the longest first: a value may be the beginning of another
    owned = owned.select(F.col("doc_id").alias("\x01id"), F.transform(F.array_sort("live"), lambda v: v["value"]).alias("\x01live"))
    joined = docs.join(owned, docs["doc_id"].eqNullSafe(F.col("\x01id")), "left")
    hidden = F.when(F.col("doc_id").isNull(), F.regexp_replace("text", PATTERN, mark)).otherwise(
        F.when(F.col("\x01live").isNull(), F.col("text")).otherwise(F.aggregate("\x01live", F.col("text"), lambda t, v: F.replace(t, v, F.lit(mark))))
    )
    out = joined.withColumn("text", hidden)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("\x01live").isNull() & F.col("doc_id").isNotNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.documents(spark, sf_dir))


SQL = f"""
WITH m AS (SELECT doc_id, source, unnest(list_distinct(regexp_extract_all(text, '{PATTERN.replace(chr(39), chr(39) * 2)}'))) AS m FROM documents),
c AS (SELECT DISTINCT doc_id, source,
 CASE WHEN regexp_matches(m, '{ASSIGNED.replace(chr(39), chr(39) * 2)}') THEN 'assignment' WHEN regexp_matches(m, '^(AKIA|AIza)') THEN 'cloud_key'
  WHEN regexp_matches(m, '^(gh._|github)') THEN 'forge_token' WHEN regexp_matches(m, '^[rs]k[-_]') THEN 'api_key' WHEN starts_with(m, 'xox') THEN 'chat_token'
  WHEN starts_with(m, 'eyJ') THEN 'signed_token' ELSE 'private_key' END AS kind,
 regexp_replace(m, '{ASSIGNED.replace(chr(39), chr(39) * 2)}', '') AS value FROM m),
j AS (SELECT value, kind, count(DISTINCT doc_id) AS n_repos, count(DISTINCT source) AS n_owners FROM c GROUP BY ALL)
SELECT DISTINCT c.doc_id, sha256(c.value) AS secret_hash, c.kind, n_repos, n_owners,
 CASE WHEN (len(list_distinct(string_split(c.value, ''))) < 8 AND c.kind <> 'private_key') OR regexp_matches(lower(c.value), '{TELLTALE}') THEN 'placeholder'
  WHEN n_owners >= 3 AND n_repos >= 5 THEN 'example' ELSE 'live' END AS verdict
FROM c JOIN j ON c.value = j.value AND c.kind = j.kind
"""
