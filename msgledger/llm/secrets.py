"""Operator 8: secret scans with DataFrame functions only: known forms, and sliding-window entropy of candidate strings."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from msgledger.llm.common import text_or_empty

# The known forms. Kinds are listed in the order that breaks ties of spans.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ["assign", "access", "hex", "entropy"]

#: Candidates: whole runs of these characters, as long as the window at least, with a digit and a letter.
WINDOW = 20
RUN = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_=-]{20,}+"
#: Bits a character that the best window must reach, by class of the run: hex digits of one case, letters of one case and digits, others.
#: log2(20) = 4.32 is the most. Of random strings of 20 characters of these classes (base 36 for the second) 2 %, 4 % and 18 % stay below, of 32 under 2 %.
HEX_BITS, SINGLE_BITS, MIXED_BITS = 3.0, 3.5, 3.9
#: Candidates that are no secrets: UUIDs, examples and placeholders, paths, slugs of words and of numbers of up to 4 digits, single-case
#: identifiers with a number at the end. No group repeats in them: Java's matcher would call itself for each turn.
ALLOWED = [
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"(?i)example|sample|placeholder|changeme|xxxx|0123456789|1234567890|abcdefgh",
    r"^[^0-9]*/[^/]+/[^/]+/",
    r"^(?=[A-Za-z0-9])(?!.*(?:[A-Za-z][0-9]|[0-9][A-Za-z]|[0-9]{5}))",
    r"^(?:[a-z]+|[A-Z]+)[0-9]{1,4}$",
]


#: Matches whose places are added up one after the other before they are joined: appending to an array copies it.
BLOCK = 256
#: Counts of a window are numbers of COUNT_BITS bits, PER_WORD of them in a BIGINT; characters count from LEAST_CODE on.
COUNT_BITS, PER_WORD, LEAST_CODE, WORDS = 5, 12, ord("+"), 7
SPANS = "array<struct<start:int,rank:int,kind:string,end:int,what:string>>"


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also where ``body`` uses it in a lambda."""
    return F.transform(F.array(value), body)[0]


def _starts(text: Column, pattern: str, what: Column, keep, kind: str) -> Column:
    """Spans of the pattern's matches, leftmost and not overlapping: their starts are the lengths of what stands between and of the matches before.

    ``what``: what ``keep`` decides by, match for match. Starts and ends count code points, as ``length`` does.
    """
    gaps = F.split(text, pattern, -1)
    found = F.arrays_zip(gaps.alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"), what.alias("what"))
    none = F.array().cast(SPANS)

    def span(start: Column, end: Column, own: Column) -> Column:
        return F.struct(start.cast("int").alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), end.cast("int").alias("end"), own.alias("what"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["match"])
        return F.struct(end.alias("at"), F.when(keep(x["what"]), F.concat(acc["spans"], F.array(span(start, end, x["what"])))).otherwise(acc["spans"]).alias("spans"))

    def block(matches: Column, lo: Column) -> Column:
        return F.aggregate(F.slice(matches, lo, BLOCK), F.struct(F.lit(0).alias("at"), none.alias("spans")), step)

    def shifted(acc: Column, b: Column) -> Column:
        own = F.transform(b["spans"], lambda s: span(s["start"] + acc["at"], s["end"] + acc["at"], s["what"]))
        return F.struct((acc["at"] + b["at"]).alias("at"), F.concat(acc["spans"], F.array(own)).alias("spans"))

    def all_spans(matches: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(1), F.size(matches), F.lit(BLOCK)), lambda lo: block(matches, lo))
        return F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPANS}>").alias("spans")), shifted, lambda acc: F.flatten(acc["spans"]))

    return F.when(text.rlike(pattern), _let(F.filter(found, lambda x: x["match"].isNotNull()), all_spans)).otherwise(none)


def window_entropy(s: Column, window: int = WINDOW, enough: Column | None = None) -> Column:
    """Largest Shannon entropy, in bits a character, of the windows of ``window`` characters of ``s``, which are of RUN's classes.

    Counts of the window's characters, packed into BIGINTs, and the sum of c log2 c over them are kept as the
    window slides: a character that enters adds to its own count, one that leaves takes from it. Once a window
    reaches ``enough``, later ones aren't looked at. Strings shorter than the window have 0.
    """
    if window >= 1 << COUNT_BITS:
        raise ValueError(f"a window has fewer than {1 << COUNT_BITS} characters")
    term = [c * math.log2(c) if c > 1 else 0.0 for c in range(window + 2)]
    step_up = F.array(*[F.lit(b - a) for a, b in zip(term, term[1:], strict=False)])  # what one more adds to the sum, by the count so far
    most = F.lit(term[window] + 1)
    reached = F.lit(-1.0) if enough is None else (F.lit(math.log2(window)) - enough) * window

    def code(c: Column) -> Column:
        k = F.ascii(c) - LEAST_CODE
        shift = k % PER_WORD * COUNT_BITS
        return F.struct(k.alias("k"), F.floor(k / PER_WORD).cast("int").alias("word"), shift.alias("shift"), F.call_function("shiftleft", F.lit(1).cast("bigint"), shift).alias("unit"))

    def change(up: Column, acc: Column, x: Column) -> Column:
        new, old = x["new"], x["old"]
        count = lambda c: F.call_function("shiftright", F.get(acc["counts"], c["word"]), c["shift"]).bitwiseAND((1 << COUNT_BITS) - 1).cast("int")
        had = lambda c, w, j: F.when(j == c["word"], c["unit"]).otherwise(F.lit(0).cast("bigint"))
        full = old.isNotNull()
        counts = F.transform(acc["counts"], lambda w, j: w + had(new, w, j) - F.when(full, had(old, w, j)).otherwise(F.lit(0).cast("bigint")))
        total = acc["sum"] + F.get(up, count(new)) - F.when(full, F.get(up, count(old) - 1)).otherwise(0.0)
        low = F.when(acc["n"] + 1 >= window, F.least(acc["low"], total)).otherwise(acc["low"])
        more = F.struct(counts.alias("counts"), total.alias("sum"), low.alias("low"), (acc["n"] + 1).alias("n"))
        return F.when((acc["low"] <= reached) | (full & (new["k"] == old["k"])), acc).otherwise(more)

    def slide(b: Column) -> Column:
        pairs = F.arrays_zip(b["codes"].alias("new"), F.concat(F.array_repeat(F.lit(None).cast("struct<k:int,word:int,shift:int,unit:bigint>"), window), b["codes"]).alias("old"))
        start = F.struct(F.array_repeat(F.lit(0).cast("bigint"), WORDS).alias("counts"), F.lit(0.0).alias("sum"), most.alias("low"), F.lit(0).alias("n"))
        return F.aggregate(F.filter(pairs, lambda x: x["new"].isNotNull()), start, lambda acc, x: change(b["up"], acc, x), lambda acc: acc["low"])

    low = _let(F.struct(F.transform(F.filter(F.split(s, ""), lambda c: c != ""), code).alias("codes"), step_up.alias("up")), slide)
    return F.when(F.length(s) >= window, F.greatest(F.lit(math.log2(window)) - low / window, F.lit(0.0))).otherwise(0.0)


def _suspicious(s: Column) -> Column:
    """Has a letter, isn't on the allow-list, and reaches its class's entropy in some window."""
    allowed = reduce(lambda a, b: a | b, [s.rlike(p) for p in ALLOWED])
    least = F.when(s.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), F.lit(HEX_BITS)).when(s.rlike("^(?:[a-z0-9]+|[A-Z0-9]+)$"), F.lit(SINGLE_BITS)).otherwise(F.lit(MIXED_BITS))
    return F.when(~s.rlike("[A-Za-z]") | allowed, F.lit(False)).otherwise(_let(least, lambda bits: window_entropy(s, enough=bits) >= bits))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """``(doc_id, base, added)`` for each row: spans ``(start, rank, kind, end, what)`` of the known forms, and those the entropy adds.

    Start and end count code points, end exclusive; ``what`` is the value or string found. Known forms: an
    assignment to a password-like name with a value of 6 characters or more, an access key id of 20 or more, a
    run of 24 or more lower-case hex digits. Added: a run of WINDOW or more characters with a letter and a
    digit that isn't on the allow-list, whose best window reaches the entropy of its class (hex digits
    of one case; letters of one case and digits; others), and that overlaps no known form.

    Whole texts; null counts as empty and has no spans. Null and repeated doc_ids are kept row by row; other
    columns are not read; an empty table gives no rows. A projection of the scan: no shuffle, no Python.
    """
    t = F.col("text")
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    every = lambda x: F.lit(True)
    whole = lambda p: F.regexp_extract_all(t, F.lit(p), F.lit(0))
    assign = _starts(t, ASSIGN, F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(1)), lambda v: F.length(v) >= 6, "assign")
    access = F.when(t.contains("AKIA"), _starts(t, ACCESS, whole(ACCESS), every, "access")).otherwise(F.array().cast(SPANS))
    known = F.array_sort(F.concat(assign, access, _starts(t, HEX, whole(HEX), every, "hex")))
    runs = _starts(t, RUN, whole(RUN), _suspicious, "entropy")
    both = base.select("doc_id", known.alias("base"), runs.alias("runs"))
    added = F.filter("runs", lambda r: ~F.exists(F.col("base"), lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))
    return both.select("doc_id", "base", added.alias("added"))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
