"""Secret scan: fixed patterns and a battery of randomness tests [native].

Matches come from regexp_extract_all, their places from the lengths of the
pieces between them (split by the same pattern), in code points.

Candidates are runs of key characters, of 14 or more with a digit or of 20 or
more, and likewise the parts of such a run between its marks, so that a key behind
a path is tested by itself; those without a letter are numbers and left out.  Each gets an encoding (hex, base32 or base64) from
its letters, and the battery tests chi-squared uniformity over that alphabet, runs
about its middle and lag-one serial correlation; three times the least of the
three p-values is their joint one, p.

exp(-L) bounds the probability that ordinary text would look so, L being the log
likelihood as uniform letters over that as text (Markov's inequality); it grows
with the length.  exp(-L) / p is then the evidence against text of a string that
is random as far as the battery can tell: the larger, the less random it looks.
Benjamini-Hochberg over all candidates on a histogram of L + ln p keeps the false
discovery rate below ``FDR``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialise

ASSIGN = "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
RANDOM = "(?=[A-Za-z0-9+/_=-]*[0-9])[A-Za-z0-9+/_=-]{14,}|[A-Za-z0-9+/_=-]{20,}"
MARKS = "[/_=-]"
PART = "(?=[A-Za-z0-9+]*[0-9])[A-Za-z0-9+]{14,}|[A-Za-z0-9+]{20,}"
KINDS = ["assign", "access", "hex", "random"]
FDR, BINS = 0.001, 400
ALPHABETS = {"hex": "0123456789abcdef", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}
#: Per mille of each letter from a to z in that European language which has it most: no language's words look random for their letters.
LETTERS = [130, 22, 47, 58, 174, 30, 36, 61, 76, 10, 12, 60, 47, 98, 110, 36, 18, 75, 79, 93, 63, 22, 24, 5, 25, 17]


def _found(text: Column, pattern: str, kind: str) -> Column:
    """array<struct<start, kind, stop, body>> of a pattern's matches."""
    body = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    gaps = F.split(text, pattern, -1)
    sizes = F.zip_with(gaps, body, lambda g, m: F.struct(F.char_length(g).alias("g"), F.char_length(m).alias("n"), m.alias("m")))
    empty = F.lit(None).cast("array<struct<start:int,kind:int,stop:int,body:string>>")
    start = F.struct(F.lit(0).alias("at"), F.coalesce(empty, F.array().cast("array<struct<start:int,kind:int,stop:int,body:string>>")).alias("out"))
    add = lambda s, x: F.struct(
        (s["at"] + x["g"] + F.coalesce(x["n"], F.lit(0))).alias("at"),
        F.when(x["m"].isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(F.struct((s["at"] + x["g"]).alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (s["at"] + x["g"] + x["n"]).alias("stop"), x["m"].alias("body"))))).alias("out"),
    )
    found = F.aggregate(sizes, start, add, lambda s: s["out"])
    if kind == "assign":
        found = F.filter(found, lambda x: F.char_length(F.regexp_extract(x["body"], ASSIGN, 2)) >= 6)
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<struct<start:int,kind:int,stop:int,body:string>>"))


def _ln_text(c: Column) -> Column:
    """log probability of a character in ordinary text: 90 % lower case, 5 % upper case, 3 % digits, 2 % marks."""
    table = [math.log(0.03 / 10)] * 10 + [math.log(0.05 * p / 1000) for p in LETTERS] + [math.log(0.90 * p / 1000) for p in LETTERS]
    at = F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"), c)
    return F.coalesce(F.get(F.array(*[F.lit(x) for x in table]), at - 1), F.lit(math.log(0.02 / 4)))


def _log_tail(z: Column) -> Column:
    """About -ln(2 * (1 - Phi(|z|)))."""
    z = F.abs(z)
    return 0.717 * z + 0.416 * z * z


def battery(found: DataFrame) -> DataFrame:
    """found(…, body) with _evidence, the log likelihood ratio plus the log of the battery's joint p-value, not below 0."""
    body = F.rtrim(F.translate("body", "-_=", "+/ "))
    coded = found.withColumn("_b", body).withColumn("_alphabet", F.when(F.lower("_b").rlike("^[0-9a-f]+$") & ((F.lower("_b") == F.col("_b")) | (F.upper("_b") == F.col("_b"))), F.lit(ALPHABETS["hex"])).when(F.col("_b").rlike("^[A-Z2-7]+$"), F.lit(ALPHABETS["base32"])).otherwise(F.lit(ALPHABETS["base64"])))
    coded = coded.withColumn("_b", F.when(F.length("_alphabet") == 16, F.lower("_b")).otherwise(F.col("_b")))
    coded = coded.withColumn("_chars", F.split("_b", "")).withColumn("_x", F.expr("transform(_chars, c -> instr(_alphabet, c) - 1)"))
    n, a = F.size("_x").cast("double"), F.length("_alphabet").cast("double")
    coded = coded.withColumns({"_n": n, "_a": a, "_lr": F.aggregate("_chars", F.lit(0.0), lambda s, c: s - _ln_text(c)) - n * F.log(a)})
    coded = coded.withColumns({
        "_chi": F.expr("_a / _n * aggregate(transform(sequence(0, cast(_a as int) - 1), k -> size(filter(_x, v -> v = k))), 0D, (s, c) -> s + c * c) - _n"),
        "_up": F.expr("cast(size(filter(_x, v -> v >= _a / 2)) as double)"),
        "_runs": F.expr("1D + size(filter(zip_with(slice(_x, 1, size(_x) - 1), slice(_x, 2, size(_x) - 1), (p, q) -> (p >= _a / 2) <> (q >= _a / 2)), d -> d))"),
        "_serial": F.expr("aggregate(zip_with(slice(_x, 1, size(_x) - 1), slice(_x, 2, size(_x) - 1), (p, q) -> (p - (_a - 1) / 2) * (q - (_a - 1) / 2)), 0D, (s, c) -> s + c) / ((_a * _a - 1) / 12) / sqrt(_n - 1)"),
    })
    mean = 1 + 2 * F.col("_up") * (F.col("_n") - F.col("_up")) / F.col("_n")
    spread = F.sqrt(F.greatest(F.lit(1e-9), (mean - 1) * (mean - 2) / (F.col("_n") - 1)))
    least = F.greatest(_log_tail(F.greatest(F.lit(0.0), (F.col("_chi") - (F.col("_a") - 1)) / F.sqrt(2 * (F.col("_a") - 1)))), _log_tail((F.col("_runs") - mean) / spread), _log_tail(F.col("_serial")))
    return coded.withColumn("_evidence", F.greatest(F.lit(0.0), F.col("_lr") - F.greatest(F.lit(0.0), least - math.log(3))))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = FDR) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    A null text is empty.  Repeated rows each get a result; other columns are
    ignored; an empty table gives no rows; a text without spans has an empty list.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = F.concat(*[_found(text, p, k) for p, k in zip((ASSIGN, ACCESS, HEX, RANDOM), KINDS)])
    spans = materialise(docs.select(F.col(id_col).alias("_id"), found.alias("_found")), "secret-spans").withColumn("_rid", F.monotonically_increasing_id())
    spans = materialise(spans, "secret-rows")
    runs = spans.select("_rid", F.explode(F.filter("_found", lambda x: x["kind"] == 3)).alias("_s"))
    marked = runs.where(F.col("_s.body").rlike(MARKS)).select("_rid", F.col("_s.start").alias("_at"), F.explode(_found(F.col("_s.body"), PART, "random")).alias("_p"))
    parts = marked.select("_rid", F.struct((F.col("_at") + F.col("_p.start")).alias("start"), F.col("_p.kind").alias("kind"), (F.col("_at") + F.col("_p.stop")).alias("stop"), F.col("_p.body").alias("body")).alias("_s"))
    tried = runs.unionByName(parts).withColumn("body", F.col("_s.body")).where(F.col("body").rlike("[A-Za-z]"))
    tested = materialise(battery(tried).select("_rid", "_s", "_evidence"), "secret-tests")
    bins = tested.groupBy(F.least(F.lit(BINS), F.floor(F.coalesce("_evidence", F.lit(0.0)))).cast("int").alias("bin")).agg(F.count("*").alias("n"))  # BINS + 1 rows at most
    above = Window.orderBy(F.desc("bin"))
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = bins.withColumns({"k": F.sum("n").over(above), "m": F.sum("n").over(every)})
    limit = ranked.where(-F.col("bin") <= F.log(fdr * F.col("k") / F.col("m"))).agg(F.min("bin")).first()[0]
    kept = tested.where(F.floor("_evidence") >= limit) if limit is not None else tested.where(F.lit(False))
    more = kept.groupBy("_rid").agg(F.collect_set("_s").alias("_more"))
    base = F.array_sort(F.filter("_found", lambda x: x["kind"] < 3))
    names = F.array(*[F.lit(k) for k in KINDS])
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["stop"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("_found", lambda x: x["kind"] == k)).cast("long")
    return spans.join(more, "_rid", "left").select(
        F.col("_id").alias(id_col), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat(base, F.coalesce("_more", F.array().cast("array<struct<start:int,kind:int,stop:int,body:string>>"))))).alias("spans"),
    )
