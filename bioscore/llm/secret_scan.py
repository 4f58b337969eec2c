"""Secrets in texts by patterns and by sliding-window entropy, in Spark SQL functions only.

Base kinds are fixed patterns, leftmost and without overlap per kind: `assign` (a value of 6
or more characters after a telling name), `access` (a key id of 20 or more characters), `hex`
(24 or more hexadecimal digits).

`entropy` adds candidate strings: maximal runs of 20 or more key characters that touch no base
span, are not on the allow-list (known forms, and strings of letters with the letter pairs of
words, as long compounds and identifiers are), and hold a window of 20 characters whose Shannon entropy
reaches the limit of the string's character class. A candidate is walked once; the counts of
the window change by the character that enters and the one that leaves.

Positions count code points. They come from the texts between the matches, so no text is cut
and nothing leaves the JVM.

Work grows in proportion to the text and its matches, however many one text has.

Defined cases: NULL is an empty text; a text without secrets has zero counts and empty lists.
Rows that repeat get equal results. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed patterns of the base kinds.
ASSIGN = (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
          r"""([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
SIGNS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{WINDOW},}}+"
# Least entropy, in bits a character, of a window: by character class, first match counts. The
# limits lie where random strings of 20 characters of the class seldom stay below; for words
# and names joined by signs they are higher, as ordinary text has such strings.
CLASSES = (("digits", r"^[0-9]+$", None), ("hex", r"^[0-9A-Fa-f]+$", 3.0),
           ("words", r"^[A-Z]?[a-z]+$", 3.3), ("capitals", r"^[A-Z]+$", 3.25),
           ("lower", r"^[a-z0-9]+$", 3.4), ("upper", r"^[A-Z0-9]+$", 3.4),
           ("letters", r"^[A-Za-z]+$", 3.55), ("mixed", r"^[A-Za-z0-9]+$", 3.65),
           ("prefixed", r"[a-z0-9]{20}|[A-Z0-9]{20}", 3.55),
           ("joined", r"^(?:[a-z0-9+/_=-]+|[A-Z0-9+/_=-]+|[A-Za-z+/_=-]+)$", 4.0),
           ("base64", r"^.*$", 3.65))
# Forms that look random and are not secret.
ALLOWED_FORMS = (
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    r"(?i)example|sample|placeholder|changeme|dummy", r"(?i)0123456789|abcdefghij",
    r"^/?(?:[a-z0-9_-]+/)+[a-z0-9_-]*$")

# Letter pairs of words in English, German, French and Spanish. Two fifths of the pairs of a
# long word are usually among them, of random letters one in seven.
USUAL_PAIRS = tuple(
    "ab ac ad ag ai al am an ar as at au be ca ce ch ck co ct de di ea ec ed ei el em en er es et "
    "ft ge ha he hi ic ie il in io is it la ld le li ll lo ly ma me na nd ne ng ni no ns nt of ol "
    "om on or ou pa pe po pr qu ra re ri ro sa sc se sh si so ss st ta te th ti to tr ts un ur us "
    "ut ve".split())
SPAN = "struct<start:int,kind:int,end:int,value:int,text:string>"
CHUNK = 128


def _let(value: Column, use: Callable) -> Column:
    """`use(value)` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _before(items: Column, value: Callable, fold: Callable, zero: int) -> Column:
    """For each item the fold of the values of all items before it.

    In two levels: aggregates copy their state at every step, so a list that grows inside one
    is kept short.
    """
    first = F.struct(F.lit(zero).alias("at"), F.array().cast("array<int>").alias("seen"))

    def run(part: Column, of: Callable) -> Column:
        return F.aggregate(part, first, lambda s, x: F.struct(
            fold(s["at"], of(x)).alias("at"),
            F.concat(s["seen"], F.array(s["at"])).alias("seen")))

    parts = F.transform(
        F.sequence(F.lit(0), F.floor(F.greatest(F.size(items) - 1, F.lit(0)) / CHUNK).cast("int")),
        lambda k: run(F.slice(items, k * CHUNK + 1, CHUNK), value))
    return _let(parts, lambda p: F.flatten(F.zip_with(
        p, run(p, lambda x: x["at"])["seen"],
        lambda x, carry: F.transform(x["seen"], lambda v: fold(v, carry)))))


def _located(text: Column, pattern: str, kind: int, value: Column | None = None,
             least: int = 0) -> Column:
    """(start, kind, end) of every match; with `value`, of those whose value is long enough."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    values = matches if value is None else value
    # arrays side by side: what a lambda names from outside would be computed per element
    zipped = F.filter(F.arrays_zip(matches.alias("m"), between.alias("b"), values.alias("v")),
                      lambda z: z["m"].isNotNull())
    sizes = F.transform(zipped, lambda z: F.struct(
        F.length(z["b"]).alias("gap"), F.length(z["m"]).alias("size"),
        F.length(z["v"]).alias("value"), z["m"].alias("text")))

    def placed(m: Column, at: Column) -> Column:
        start = at + m["gap"]
        return F.struct(start.alias("start"), F.lit(kind).alias("kind"),
                        (start + m["size"]).alias("end"), m["value"].alias("value"),
                        m["text"].alias("text"))

    found = _let(sizes, lambda items: F.zip_with(
        items, _before(items, lambda m: m["gap"] + m["size"], lambda x, y: x + y, 0), placed))
    found = F.filter(found, lambda m: m["value"] >= least)
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(f"array<{SPAN}>"))


def _clear(candidates: Column, base: Column) -> Column:
    """The candidates that touch no base span.

    Among all spans in order, the base spans before a candidate must end where it starts or
    earlier, and the next base span must not start before it ends.
    """
    last = len(KINDS) - 1
    latest = 2 ** 31 - 1

    def kept(order: Column) -> Column:
        reach = _before(order, lambda s: F.when(s["kind"] < last, s["end"]).otherwise(0),
                        F.greatest, 0)
        following = F.reverse(_before(
            F.reverse(order), lambda s: F.when(s["kind"] < last, s["start"]).otherwise(latest),
            F.least, latest))
        marked = F.zip_with(order, F.arrays_zip(reach.alias("r"), following.alias("f")),
                            lambda s, x: F.struct(s.alias("span"), x.alias("x")))
        clear = F.filter(marked, lambda m: (m["span"]["kind"] == last)
                         & (m["x"]["r"] <= m["span"]["start"]) & (m["x"]["f"] >= m["span"]["end"]))
        return F.transform(clear, lambda m: m["span"])

    return F.when((F.size(candidates) > 0) & (F.size(base) > 0),
                  _let(F.array_sort(F.concat(base, candidates)), kept)).otherwise(candidates)


def window_entropy(candidate: Column, window: int = WINDOW) -> Column:
    """Largest Shannon entropy of any window, from counts kept while the window moves.

    sum n·log2(n) over the counts n is kept as well; the entropy is log2(window) less that
    sum over the window size.
    """
    codes = F.transform(F.split(candidate, ""), lambda c: F.instr(F.lit(SIGNS), c))
    gone = F.concat(F.array_repeat(F.lit(-1), window), codes)
    moves = F.filter(F.zip_with(codes, gone, lambda x, y: F.struct(x.alias("new"), y.alias("old"))),
                     lambda m: m["new"].isNotNull())
    share = F.array(*[F.lit(n * math.log2(n) if n else 0.0) for n in range(window + 2)])
    zeros = F.array_repeat(F.lit(0), len(SIGNS) + 1)
    first = F.struct(F.lit(0).alias("i"), zeros.alias("counts"), F.lit(0.0).alias("sum"),
                     F.lit(float("inf")).alias("least"))

    def step(state, move):
        code, gone = move["new"], move["old"]
        full = gone >= 0
        n_out = F.when(full, F.get(state["counts"], gone)).otherwise(F.lit(1))
        leave = F.when(full, F.get(share, n_out - 1) - F.get(share, n_out)).otherwise(F.lit(0.0))
        n_in = F.get(state["counts"], code) - F.when(gone == code, 1).otherwise(0)
        enter = F.get(share, n_in + 1) - F.get(share, n_in)
        total = state["sum"] + leave + enter
        counts = F.transform(state["counts"], lambda n, k: n + F.when(k == code, 1).otherwise(0)
                             - F.when(k == gone, 1).otherwise(0))
        least = F.when(state["i"] >= window - 1, F.least(state["least"], total)) \
            .otherwise(state["least"])
        return F.struct((state["i"] + 1).alias("i"), counts.alias("counts"), total.alias("sum"),
                        least.alias("least"))

    least = F.aggregate(moves, first, step, lambda s: s["least"])
    return F.round(F.lit(math.log2(window)) - least / window, 9)


def _wordlike(candidate: Column) -> Column:
    """True where a string of letters holds as many usual letter pairs as words do."""
    usual = F.regexp_count(F.lower(candidate), F.lit(f"(?={'|'.join(USUAL_PAIRS)})"))
    return candidate.rlike("^[A-Za-z]+$") & (usual * 5 >= (F.length(candidate) - 1) * 2)


def _suspicious(candidate: Column, allowed: Sequence[str]) -> Column:
    limit = F.lit(None).cast("double")
    for _, form, least in reversed(CLASSES):
        limit = F.when(candidate.rlike(form), F.lit(least).cast("double")).otherwise(limit)
    listed = _wordlike(candidate)
    for form in ALLOWED_FORMS:
        listed = listed | candidate.rlike(form)
    if allowed:
        listed = listed | candidate.isin(list(allowed))
    return F.when(listed | limit.isNull(), F.lit(False)) \
        .otherwise(window_entropy(candidate) >= limit)


def _named(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 allowed: Sequence[str] = ()) -> DataFrame:
    """doc_id, counts and digest of the base kinds, and all spans.

    `allowed` holds exact strings that are known not to be secret; it bounds the plan, so it
    is meant for hundreds, not millions.
    """
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = rows.select("doc_id", body.alias("text"))
    text_ = F.col("text")
    rows = rows.select(
        "doc_id",
        _located(text_, ASSIGN, 0, F.regexp_extract_all(text_, F.lit(ASSIGN), F.lit(1)), 6)
        .alias("assign"),
        _located(text_, ACCESS, 1).alias("access"), _located(text_, HEX, 2).alias("hex"),
        _located(text_, CANDIDATE, 3).alias("candidates"))
    rows = rows.select("*", F.concat("assign", "access", "hex").alias("base"))
    clear = _clear(F.col("candidates"), F.col("base"))
    rows = rows.select("*", F.filter(clear, lambda c: _suspicious(c["text"], allowed))
                       .alias("entropy"))
    count = lambda name: F.size(name).cast("bigint")
    return rows.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(_named(F.array_sort("base")), 256).alias("base_sha256"),
        _named(F.array_sort(F.concat("base", "entropy"))).alias("spans"),
        count("entropy").alias("n_entropy"))
