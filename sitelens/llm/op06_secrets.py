"""Secret scan with a ledger of blobs; DataFrame functions only.

A text is a version at a path and is addressed by its SHA-256. The ledger says which (blob, rule,
rule version) triples were scanned and what was found. A scan hashes all versions, reads the texts of
one holder of each blob that misses a rule version, scans these, adds them to the ledger, and joins
the findings back to every path by content address.

Built-in functions find matches but not their places. A text split by a pattern gives the gaps between
its matches, so the places are running sums of the lengths of gaps and matches, in code points: a
window over the matches of a blob and rule, which are few and carry lengths only.

Cases: a null text is empty and holds nothing. Repeated rows and ids keep one result row each. Other
columns are not read. An empty table gives no rows and leaves the ledger as it was.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, texts

#: fixed value: key words of assignments
ASSIGN_WORDS = "password|passwd|secret|token|api_?key"


@dataclass(frozen=True)
class Rule:
    """group: the part whose length counts; matches with a shorter one are dropped after matching."""
    kind: str
    pattern: str
    group: int
    least: int
    version: int = 1


BASE = [
    Rule("assign", rf"""((?i:{ASSIGN_WORDS}))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    # as runs are maximal, a least length inside the pattern gives the same spans as dropping short runs
    Rule("access", r"(AKIA[A-Z0-9]{16,})", 1, 20),
    Rule("hex", r"([0-9a-f]{24,})", 1, 24),
]
#: added to the base: upper-case digests, signed web tokens, key headers, credentials in addresses
MORE = [
    Rule("hexup", r"([0-9A-F]{24,})", 1, 24),
    Rule("jwt", r"(eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+)", 1, 24),
    Rule("pem", r"(-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----)", 1, 20),
    Rule("userinfo", r"[a-z]{2,12}://([^\s/:@]+:[^\s/@]{3,})@", 1, 5),
]
RULES = BASE + MORE
#: a text without the marker of a rule is not searched for it
MARKERS = {"assign": r"[:=]", "access": "AKIA", "jwt": "eyJ", "pem": "-----BEGIN", "userinfo": "://"}
LEDGER = "blob string, rules array<string>, spans array<struct<start:bigint,kind:string,end:bigint>>"


def rule_id(rule: Rule) -> str:
    return f"{rule.kind}:{rule.version}"


def matches(text: F.Column, rule: Rule) -> F.Column:
    """Of each match of the rule: its place in order, the gap before it, its length, the length that
    counts."""
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)).alias("m"),
                         F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)).alias("p"),
                         F.split(text, rule.pattern, -1).alias("g"))
    rows = F.transform(F.filter(found, lambda x: x["m"].isNotNull()), lambda x, i: F.struct(
        F.lit(rule.kind).alias("kind"), i.cast("int").alias("i"), F.length(x["g"]).cast("long").alias("gap"),
        F.length(x["m"]).cast("long").alias("n"), F.length(x["p"]).cast("int").alias("held")))
    return F.when(text.rlike(MARKERS.get(rule.kind, rule.pattern)), rows)


def scan(versions: DataFrame, rules: list[Rule], ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(doc_id, blob, spans of every version; the new rows of the ledger, stored). spans holds what
    the given rule versions found, sorted by start, then rule order."""
    spark = versions.sparkSession
    want, order = F.array(*(F.lit(rule_id(r)) for r in rules)), {r.kind: i for i, r in enumerate(rules)}
    addressed = texts(versions).select("doc_id", "text", F.sha2(F.col("text").cast("binary"), 256).alias("blob"))
    holders = addressed.groupBy("blob").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id"))["doc_id"].alias("holder"))
    if ledger is not None:
        seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("rules"))).alias("seen"))
        holders = (holders.join(seen, "blob", "left").withColumn("rules", F.array_except(want, F.coalesce("seen", F.array().cast("array<string>"))))
                   .where(F.size("rules") > 0).select("blob", "holder", "rules"))
    else:
        holders = holders.withColumn("rules", want)
    todo = addressed.withColumnsRenamed({"doc_id": "holder", "blob": "at"}).join(
        holders.withColumnRenamed("holder", "by"), F.col("holder").eqNullSafe(F.col("by")) & (F.col("at") == F.col("blob")))
    none = F.array().cast("array<struct<kind:string,i:int,gap:bigint,n:bigint,held:int>>")
    found = F.concat(*(F.coalesce(F.when(F.array_contains("rules", rule_id(r)), matches(F.col("text"), r)), none) for r in rules))
    rows = todo.select("blob", F.explode(found).alias("m")).select("blob", "m.*").distinct()  # a repeated row is scanned alike
    until = F.sum(F.col("gap") + F.col("n")).over(Window.partitionBy("blob", "kind").orderBy("i"))
    least = F.create_map(*(x for r in rules for x in (F.lit(r.kind), F.lit(r.least))))
    placed = (rows.withColumn("end", until).where(F.col("held") >= least[F.col("kind")])
              .groupBy("blob").agg(F.collect_list(F.struct((F.col("end") - F.col("n")).alias("start"), "kind", "end")).alias("spans")))
    fresh = staged(holders.join(placed, "blob", "left").select("blob", "rules", F.coalesce("spans", F.array().cast(placed.schema["spans"].dataType)).alias("spans")))
    current = fresh if ledger is None else fresh.unionByName(ledger)
    valid = current.select("blob", F.explode("spans").alias("s"), "rules")
    # a span counts if its rule was scanned in the version that is asked for
    versions_of = F.create_map(*(x for r in rules for x in (F.lit(r.kind), F.lit(rule_id(r)))))
    rank = F.create_map(*(F.lit(x) for kv in order.items() for x in kv))
    valid = (valid.where(F.array_contains(F.col("rules"), versions_of[F.col("s.kind")])).select("blob", "s.*").distinct()
             .groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", rank[F.col("kind")].alias("rank"), "end", "kind"))).alias("spans")))
    out = addressed.select("doc_id", "blob").join(valid, "blob", "left").select("doc_id", "blob", F.coalesce("spans", F.array().cast(valid.schema["spans"].dataType)).alias("spans"))
    return out, fresh


def empty_ledger(spark) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def joined(spans: F.Column) -> F.Column:
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])))


def report(found: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans, all spans as text."""
    base = [r.kind for r in BASE]

    def of(kinds):
        return F.filter("spans", lambda x: x["kind"].isin(kinds))

    return found.select(
        "doc_id", *(F.size(of([k])).cast("long").alias(f"n_{k}") for k in base),
        F.sha2(joined(of(base)).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def secret_report(docs: DataFrame, deliveries: int = 2) -> DataFrame:
    """report of all rows of docs, which arrive in that many deliveries: each scan knows the ledger of
    those before it and reads the texts of unseen blobs alone; the last one joins all findings back."""
    part, ledger = F.pmod(F.xxhash64("doc_id", "text"), F.lit(deliveries)), None
    for i in range(deliveries - 1):
        _, fresh = scan(docs.where(part == i), RULES, ledger)
        ledger = fresh if ledger is None else ledger.unionByName(fresh)
    return report(scan(docs, RULES, ledger)[0])


def redacted(docs: DataFrame, rules: list[Rule] = RULES, mark: str = "[secret]") -> DataFrame:
    """docs with their secrets replaced by the mark; all rows and columns stay, clean texts as they are."""
    found = scan(docs, rules)[0].where(F.size("spans") > 0).select("blob", "spans").dropDuplicates(["blob"])
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.sha2(F.coalesce(docs["text"], F.lit("")).cast("binary"), 256).alias("own"))
    joined_rows, text = rows.join(found, F.col("own") == F.col("blob"), "left"), F.col("row.text")
    cut = F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")), lambda acc, s: F.struct(
        F.greatest(acc["at"], s["end"]).alias("at"),
        F.when(s["start"] < acc["at"], acc["out"]).otherwise(
            F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mark))).alias("out")))
    whole = F.concat(cut["out"], F.substring(text, (cut["at"] + 1).cast("int"), F.length(text)))
    clean = F.when(F.col("spans").isNull(), text).otherwise(whole)
    return joined_rows.select(*(clean.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))
