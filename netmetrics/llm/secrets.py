"""Secret scans with an incremental blob ledger: DataFrame operations only.

Every version of every path is addressed by the SHA-256 of its text. The ledger holds (blob, rule_version, spans) for what
was scanned before; a scan takes one text for each blob that has no entry under the present rule version, and findings are
joined back to all paths and versions that hold the blob.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netmetrics.llm import common as c

#: Fixed by the contract, in the order in which kinds are listed: kind, pattern, group that must be so long, its length.
#: A shorter run of the last two can't hide a longer one, so their length stands in the pattern.
BASE = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: What the method adds.
EXTRA = (
    ("pem", r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----", 0, 1),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{20,}", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{16,}\.eyJ[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}", 0, 1),
    ("google", r"AIza[A-Za-z0-9_-]{35}", 0, 1),
)
RULES = BASE + EXTRA
SPANS = "array<struct<start:int,kind:int,end:int>>"
#: Matches whose places are summed up in one go; appending costs the square of it, whatever the text's length.
STEP = 64
#: Copies of a blob are spread over so many keys when findings are joined back to their paths.
SALTS = 16


def rule_version(rules=RULES) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def kind_spans(text: Column, number: int, rule: tuple) -> Column:
    """The spans of one rule: the pieces between matches and the matches, their lengths summed up, STEP matches at a time."""
    _, pattern, group, least = rule
    found = F.regexp_extract_all(text, F.lit(f"({pattern})" if group else pattern), F.lit(1 if group else 0))
    pairs = F.zip_with(found, F.split(text, pattern, -1), lambda m, gap: F.struct(m.alias("m"), F.length(gap).alias("gap")))
    pairs = F.filter(pairs, lambda p: p["m"].isNotNull())  # one piece more than matches

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + p["gap"]
        end = start + F.length(p["m"])
        long_enough = F.length(F.regexp_extract(p["m"], pattern, group)) >= least if group else F.length(p["m"]) >= least
        own = F.array(F.struct(start.alias("start"), F.lit(number).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(long_enough, F.concat(acc["out"], own)).otherwise(acc["out"]).alias("out"))

    def follow(acc: Column, part: Column) -> Column:
        own = F.array(F.struct(acc["at"].alias("at"), part["out"].alias("out")))
        return F.struct((acc["at"] + part["at"]).alias("at"), F.concat(acc["out"], own).alias("out"))

    def moved(part: Column) -> Column:
        return F.transform(part["out"], lambda s: F.struct((s["start"] + part["at"]).alias("start"), s["kind"].alias("kind"), (s["end"] + part["at"]).alias("end")))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))
    first = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<struct<at:int,out:{SPANS}>>").alias("out"))
    parts = F.transform(F.sequence(F.lit(1), F.size(pairs), F.lit(STEP)), lambda i: F.aggregate(F.slice(pairs, i, STEP), zero, step))
    whole = F.aggregate(parts, first, follow, lambda acc: F.flatten(F.transform(acc["out"], moved)))
    return F.when(text.rlike(pattern), whole).otherwise(F.array().cast(SPANS))


def spans(text: Column, rules=RULES) -> Column:
    """All spans of a text by start, then kind as listed; in code points, the end exclusive."""
    suspect = "|".join(f"(?:{r[1]})" for r in rules)
    return F.when(text.rlike(suspect), F.array_sort(F.concat(*(kind_spans(text, k, r) for k, r in enumerate(rules))))).otherwise(F.array().cast(SPANS))


def blob(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256))


def scan_new(versions: DataFrame, path: str, text: str, ledger: DataFrame | None = None, rules=RULES) -> DataFrame:
    """Ledger entries (blob, rule_version, spans) for the blobs of versions that the ledger lacks under these rules.

    path is a number; a path may have many versions. One text of each unseen blob is scanned: that of its least path, met
    by path and blob together, so versions of a path meet each their own blob only.
    """
    own = versions.select(c.key(path).alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")).withColumn("blob", blob(F.col("t")))
    first = own.groupBy("blob").agg(F.min("k").alias("k"))
    if ledger is not None:
        first = first.join(ledger.where(F.col("rule_version") == rule_version(rules)).select("blob"), "blob", "left_anti")
    one = own.join(first.hint("shuffle_hash"), ["k", "blob"], "left_semi").dropDuplicates(["k", "blob"])
    return one.select("blob", F.lit(rule_version(rules)).alias("rule_version"), spans(F.col("t"), rules).alias("spans"))


def secrets(versions: DataFrame, path: str = "doc_id", text: str = "text", ledger: DataFrame | None = None, rules=RULES) -> tuple[DataFrame, DataFrame]:
    """(findings, ledger): a row (path, blob, spans) for each row of versions, and the ledger with the new entries.

    Nulls and empty texts are the empty blob, without findings; very long texts are scanned whole. A null path is a path of
    its own, and rows that repeat a path are its versions. The new entries are a table in the shared folder.
    """
    new = c.written(scan_new(versions, path, text, ledger, rules), c.shared_dir(versions.sparkSession), "ledger")
    whole = new if ledger is None else ledger.unionByName(new)
    hot = whole.where((F.col("rule_version") == rule_version(rules)) & (F.size("spans") > 0)).select("blob", "spans")
    hot = hot.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    paths = versions.select(F.col(path), blob(F.col(text)).alias("blob"), F.pmod(F.hash(F.col(path)), F.lit(SALTS)).alias("salt"))
    return paths.join(hot, ["blob", "salt"], "left").select(F.col(path), "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans")), whole


def joined(column: Column, rules=RULES) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*(F.lit(r[0]) for r in rules))
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def secret_report(documents: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for each row of documents."""
    found, _ = secrets(documents.select(documents["doc_id"].cast("long").alias("doc_id"), documents["text"].cast("string").alias("text")), ledger=ledger)

    def of_kind(k: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")

    count = [of_kind(k).alias(f"n_{r[0]}") for k, r in enumerate(BASE)]
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    return found.select("doc_id", *count, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
