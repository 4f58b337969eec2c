"""Surrogates for personal data: keyed, consistent over the corpus, and never shared.

Detected: e-mail addresses, IPv4 and IPv6 addresses, phone numbers, payment cards and other numbers of
13 to 19 digits, social security numbers, IBANs, and names after a title. A surrogate has the
form of what it replaces: separators, lengths, country code, leading digit, check digits,
private or public address range, letter case; for names also the script and the gender of the
title. Later mentions of a detected name in the same text are replaced alike.

A surrogate is a keyed function of (kind, entity, attempt), so one entity has one surrogate in
all documents. Pass 1 gathers the distinct entities; those whose surrogate equals a real
entity or that of another entity (the smallest keeps it) try further attempts until none is
left. Only these exceptions are stored. They travel to the tasks of pass 2 in blocks of at
most `EXCEPTIONS` rows, one pass per block; texts are never shuffled.

Defined cases: NULL texts stay NULL, texts without entities stay as they are. Rows that repeat
get equal results. Extra columns are ignored or, in `replaced`, kept.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import modest_batches, written

KEY = "surrogates"
EXCEPTIONS = 200_000
ATTEMPTS = 64
CROWDED = 6         # attempts after which a small private range gives way to 10/8

# Titles before a name, with the gender they tell.
TITLES = {"Mr": "m", "Mr.": "m", "Mister": "m", "Herr": "m", "Señor": "m", "Sr.": "m",
          "Monsieur": "m", "господин": "m", "Господин": "m", "г-н": "m", "κύριος": "m",
          "Mrs": "f", "Mrs.": "f", "Ms": "f", "Ms.": "f", "Miss": "f", "Frau": "f",
          "Señora": "f", "Sra.": "f", "Señorita": "f", "Madame": "f", "Mme": "f",
          "Mademoiselle": "f", "госпожа": "f", "Госпожа": "f", "г-жа": "f", "κυρία": "f",
          "Dr.": "n", "Prof.": "n", "Dr": "n", "Prof": "n"}

_titles = "|".join(re.escape(t) for t in sorted(TITLES, key=len, reverse=True))
_part = r"(?:[^\W\d_]\.|[^\W\d_][^\W\d_]+(?:['’-][^\W\d_]+)*)"
_gap = r"[\x20./()\xa0\u2011\u202f-]{0,3}"           # between digits of one number
_blank = r"[\x20.\xa0\u2011\u202f-]"
_phone = "(?:" + "|".join((
    # after a country code: +1, +33 and +34 have fixed lengths, others 7 to 15 digits
    rf"(?:\+|00)1(?:{_gap}\d){{10}}", rf"(?:\+|00)3[34](?:{_gap}\(0\))?(?:{_gap}[1-9])(?:{_gap}\d){{8}}",
    rf"\+[1-9](?:{_gap}\d){{6,14}}", rf"00[1-9](?:{_gap}\d){{8,14}}",
    # with a leading 0, but no date: pairs, area code and groups, or digits alone
    rf"0[1-9](?:{_blank}?\d\d){{4}}",
    rf"(?!\d\d?[\x20./-]\d\d?[\x20./-](?:(?:19|20)\d\d(?!\d)|\d\d(?!\d|{_blank}\d\d)))"
    rf"(?=(?:{_gap}\d){{7}})(?!(?:{_gap}\d){{16}})"
    rf"(?:\(0[1-9]\d{{0,4}}\)[\x20\xa0]?|0[1-9]\d{{0,4}}(?:\x20?[/-]\x20?|{_blank}))\d{{2,8}}(?:{_blank}\d{{1,6}}){{0,5}}",
    r"0[1-9]\d{5,11}",
    # Spanish, and North American with and without area code
    rf"[6-9]\d\d(?:{_blank}\d\d){{3}}", r"[6-9]\d{8}", r"[2-9]\d{9}",
    r"(?<!-)\d{3}-\d{4}(?!-)")) + ")"
_six = r"[0-9A-Fa-f]{1,4}"
PATTERN = re.compile(
    # signs before the first letter are no part of the address: emphasis, list marks, %20
    r"(?<![A-Za-z0-9._%+-])(?:%[0-9A-Fa-f]{2}(?=[A-Za-z0-9._%+-])|[._%+-])*+"
    r"(?P<email>[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"
    r"|(?P<ip>(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\w))"
    rf"|(?P<ipv6>(?<![\w.])(?:(?:{_six}:){{7}}{_six}|(?:[23][0-9A-Fa-f]{{3}}|[Ff][C-Fc-f][0-9A-Fa-f]{{2}})"
    rf"(?::{_six}){{0,6}}::(?:{_six}(?::{_six}){{0,5}})?)(?!\w|:[0-9A-Fa-f:]))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?!\w))"
    r"|(?P<card>(?<![\w+])(?!00[1-9](?:[\x20-]?\d){8,12}(?![\x20-]?\d))\d(?:[\x20-]?\d){12,18}(?!\w))"
    rf"|(?P<phone>(?<![\w+]){_phone}(?!\w)"
    r"|(?<![\w+])(?:\+\d{1,3}[\x20.-]?)?(?:\(\d{2,4}\)[\x20.-]?|\d{2,4}[\x20.-])\d{3,4}(?:[\x20.-]\d{2,4}){1,2}(?!\w)"
    r"|(?<!\w)\+\d{7,15}(?!\w))"
    rf"|(?P<name>(?<!\w)(?:{_titles})(?:\x20{_part}){{1,3}})")
# Texts that this faster pattern passes over hold no entity.
HINT = rf"\p{{Nd}}|@|(?:{_titles})\x20"

LATIN = ("b d f g k l m n p r s t v br dr gr kl st tr".split(), list("aeiou"))
CYRILLIC = ("б в г д к л м н п р с т бр др ст".split(), list("аеиоу"))
GREEK = ("β γ δ κ λ μ ν π ρ σ τ φ στ".split(), list("αεηιο"))
ENDINGS = {"latin": {"m": ["n", "rt", "s"], "f": ["a", "ia", "ela"], "n": ["in", "el", "is"]},
           "cyrillic": {"m": ["н", "р", "й"], "f": ["а", "ия", "на"], "n": ["ин", "ен"]},
           "greek": {"m": ["ος", "ης"], "f": ["α", "η"], "n": ["ις"]}}


class Stream:
    """Numbers drawn from a keyed hash of the entity."""

    def __init__(self, key: str, *parts):
        text = "\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass")
        self.key = hashlib.sha256(key.encode()).digest()
        self.seed, self.count, self.pool = text, 0, 0
        self.left = 0

    def below(self, n: int) -> int:
        if self.left < 1 << 64:
            block = hashlib.blake2b(self.seed + self.count.to_bytes(4, "big"), key=self.key)
            self.pool, self.left, self.count = int.from_bytes(block.digest(), "big"), 1 << 512, \
                self.count + 1
        self.pool, out = divmod(self.pool, n)
        self.left //= n
        return out

    def digits(self, n: int) -> str:
        return "".join(str(self.below(10)) for _ in range(n))


def luhn(digits: str) -> bool:
    total = sum(int(d) if k % 2 == 0 else (int(d) * 2 - 9 * (int(d) > 4))
                for k, d in enumerate(reversed(digits)))
    return total % 10 == 0


def _fill(form: str, digits: str) -> str:
    """The digits in the places of the digits of `form`."""
    taken = iter(digits)
    return "".join(next(taken) if c.isdigit() else c for c in form)


def _script(word: str) -> str:
    if any("Ѐ" <= c <= "ӿ" for c in word):
        return "cyrillic"
    return "greek" if any("Ͱ" <= c <= "Ͽ" for c in word) else "latin"


def _word(stream: Stream, length: int) -> str:
    """Letters in which consonants and vowels take turns."""
    return "".join((["b", "d", "f", "g", "k", "l", "m", "n", "p", "r", "s", "t", "v", "z"]
                    if k % 2 == 0 else LATIN[1])[stream.below(14 if k % 2 == 0 else 5)]
                   for k in range(length))


def _like(form: str, made: str) -> str:
    if form.isupper() and len(form) > 1:
        return made.upper()
    return made[:1].upper() + made[1:] if form[:1].isupper() else made


def _letters_and_digits(form: str, stream: Stream, extra: int) -> str:
    out = re.sub(r"[A-Za-z]+|\d", lambda m: stream.digits(1) if m[0].isdigit()
                 else _like(m[0], _word(stream, len(m[0]))), form)
    return out + _word(stream, extra)


def surrogate(key: str, kind: str, entity: str, attempt: int = 0) -> str:
    """Replacement of one entity; `entity` is in the form of `normal`."""
    s = Stream(key, kind, attempt, entity)
    if kind == "email":
        local, _, domain = entity.partition("@")
        labels = domain.split(".")
        firm = Stream(key, "domain", domain)
        kept = [w if w == "example" or k == len(labels) - 1 else _letters_and_digits(w, firm, 0)
                for k, w in enumerate(labels)]
        return f"{_letters_and_digits(local, s, 2 * (attempt // 4))}@{'.'.join(kept)}"
    if kind == "ip":
        old = [int(x) for x in entity.split(".")]
        if old[0] in (10, 127):
            return ".".join(map(str, [old[0], s.below(256), s.below(256), 1 + s.below(254)]))
        if attempt >= CROWDED and (old[:2] == [192, 168] or old[0] == 172 and 16 <= old[1] < 32):
            return f"10.{s.below(256)}.{s.below(256)}.{1 + s.below(254)}"
        if old[:2] == [192, 168]:
            return f"192.168.{s.below(256)}.{1 + s.below(254)}"
        if old[0] == 172 and 16 <= old[1] < 32:
            return f"172.{16 + s.below(16)}.{s.below(256)}.{1 + s.below(254)}"
        first = [n for n in range(1, 224) if n not in (10, 127, 172, 192)]
        return f"{first[s.below(len(first))]}.{s.below(256)}.{s.below(256)}.{1 + s.below(254)}"
    if kind == "ipv6":
        first = entity[:4] if entity[0] in "f" else f"{0x2000 + s.below(0x2000):x}"
        made = ":".join([first, *(f"{s.below(1 << 16):x}" for _ in range(7))])
        return ipaddress.IPv6Address(made).compressed
    if kind == "ssn":
        return f"9{s.digits(2)}-{1 + s.below(99):02d}-{1 + s.below(9999):04d}"
    if kind == "card":
        body = entity[0] + s.digits(len(entity) - 2)
        last = next(d for d in "0123456789" if luhn(body + d))
        return body + (last if luhn(entity) else str((int(last) + 1 + s.below(9)) % 10))
    if kind == "phone":
        country, national = entity.split("|")
        zeros = national[:len(national) - len(national.lstrip("0"))]        # a trunk prefix stays
        rest = max(1, len(national) - len(zeros))
        return f"{country}|{(zeros + str(2 + s.below(8)))[-len(national):]}{s.digits(rest - 1)}"
    if kind == "iban":
        body = "".join(s.digits(1) if c.isdigit() else chr(65 + s.below(26)) for c in entity[4:])
        number = "".join(str(int(c, 36)) for c in body + entity[:2] + "00")
        return f"{entity[:2]}{98 - int(number) % 97:02d}{body}"
    # a part of a name: gender|g or s (given or family)|word
    gender, place, word = entity.split("|")
    script = _script(word)
    consonants, vowels = {"latin": LATIN, "cyrillic": CYRILLIC, "greek": GREEK}[script]
    made = "".join(consonants[s.below(len(consonants))] + vowels[s.below(len(vowels))]
                   for _ in range(2 + attempt // 8))
    if place == "g":
        ends = ENDINGS[script][gender]
        made += ends[s.below(len(ends))]
    elif script == "cyrillic":
        made += "ова" if word.lower().endswith("а") else "ов"
    else:
        made += consonants[s.below(len(consonants))] + vowels[s.below(len(vowels))]
    return made


def normal(kind: str, text: str) -> str:
    """The form under which mentions of one entity are equal."""
    if kind != "name" and not text.isascii():
        text = "".join(str(unicodedata.decimal(c)) if c.isdecimal() else c for c in text)
    if kind == "email":
        return text.lower()
    if kind in ("card", "ssn"):
        return text if kind == "ssn" else re.sub(r"\D", "", text)
    if kind == "iban":
        return text.replace(" ", "")
    if kind == "phone":
        m = re.match(r"(?:\+|00)(\d{1,3})(?=\D)", text)
        abroad = text.startswith(("+", "00"))
        digits = re.sub(r"\D", "", text)[2 * text.startswith("00"):]
        country = m[1] if m else "1" if abroad and digits[0] == "1" else digits[:2] * abroad
        return f"{country}|{digits[len(country):]}"
    if kind == "ip":
        return ".".join(str(int(x)) for x in text.split("."))
    if kind == "ipv6":
        try:
            return ipaddress.IPv6Address(text).compressed
        except ValueError:              # too many groups
            return text.lower()
    return text


def _name_parts(text: str) -> tuple[str, list[tuple[int, str, str]]]:
    """Title end and (start, word, entity) of each name part but initials."""
    m = re.match(rf"(?:{_titles})\x20", text)
    gender = TITLES[m[0][:-1]]
    words = list(re.finditer(r"\S+", text[m.end():]))
    words = words[:next((k for k, w in enumerate(words) if not w[0][0].isupper()), len(words))]
    out = []
    for k, w in enumerate(words):
        if w[0].endswith("."):
            continue
        place = "s" if k == len(words) - 1 else "g"
        out.append((m.end() + w.start(), w[0],
                    f"{gender if place == 'g' else 'n'}|{place}|{w[0].lower()}"))
    return m[0], out


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, entity) of all mentions, in order and without overlap."""
    out, names = [], {}
    for m in PATTERN.finditer(text):
        kind = m.lastgroup
        if kind != "name":
            out.append((m.start(kind), m.end(kind), kind, normal(kind, m[kind])))
            continue
        for start, word, entity in _name_parts(m[0])[1]:
            out.append((m.start() + start, m.start() + start + len(word), "name", entity))
            if len(word) > 2:
                names.setdefault(word, entity)
    if names:
        taken = [(a, b) for a, b, _, _ in out]
        again = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, sorted(names))) + r")(?!\w)")
        for m in again.finditer(text):
            if not any(a < m.end() and m.start() < b for a, b in taken):
                out.append((m.start(), m.end(), "name", names[m[0]]))
        out.sort()
    return out


def shaped(kind: str, made: str, mention: str) -> str:
    """A surrogate in the form of the mention it replaces."""
    if kind in ("email", "ipv6"):
        return made.upper() if mention.isupper() else made
    if kind == "phone":
        return _fill(mention, "00" * mention.startswith("00") + made.replace("|", ""))
    if kind in ("card", "iban"):
        taken = iter(made)
        return "".join(c if c in " -" else next(taken) for c in mention)
    return _like(mention, made) if kind == "name" else made


def _hinted(column):
    return pc.fill_null(pc.match_substring_regex(column, HINT), False).to_pylist()


def _gather(batches):
    for batch in batches:
        found = {(kind, entity) for text, hint in zip(batch.column("text").to_pylist(),
                                                      _hinted(batch.column("text"))) if hint
                 for _, _, kind, entity in entities(text)}
        rows = sorted(found)
        yield pa.record_batch([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)],
                              ["kind", "entity"])


def _made(key: str, attempt: int):
    def run(batches):
        for batch in batches:
            pairs = zip(batch.column("kind").to_pylist(), batch.column("entity").to_pylist())
            made = [surrogate(key, k, e, attempt) for k, e in pairs]
            yield pa.record_batch([batch.column("kind"), batch.column("entity"),
                                   pa.array(made, pa.string())], ["kind", "entity", "made"])
    return run


def exceptions(docs: DataFrame, key: str = KEY, text: str = "text") -> DataFrame:
    """kind, entity, made: surrogates of the entities whose first attempt is taken."""
    rows = modest_batches(docs).select(F.col(text).alias("text")).where("text is not null")
    real = written(rows.mapInArrow(_gather, "kind string, entity string").distinct(), "entities")
    names = real.where("kind = 'name'").select(
        "kind", F.element_at(F.split("entity", r"\|"), -1).alias("made")).distinct()
    taken_names = real.where("kind <> 'name'").select("kind", F.col("entity").alias("made"))
    forbidden = taken_names.unionByName(names)
    shape = "kind string, entity string, made string"
    open_, kept, settled = real, None, None
    for attempt in range(ATTEMPTS):
        tried = open_.mapInArrow(_made(key, attempt), shape)
        free = tried.join(forbidden, ["kind", "made"], "left_anti")
        if settled is not None:
            free = free.join(settled.select("kind", "made"), ["kind", "made"], "left_anti")
        first = free.groupBy("kind", "made").agg(F.min("entity").alias("entity"))
        good = written(first.select("kind", "entity", "made"), "surrogates")
        open_ = written(open_.join(good, ["kind", "entity"], "left_anti"), "open")
        settled = good if settled is None else settled.unionByName(good)
        if attempt:
            kept = good if kept is None else kept.unionByName(good)
        if not open_.take(1):
            break
    else:
        raise RuntimeError("some entities found no free surrogate")
    return kept if kept is not None else good.limit(0)


def _rewriter(shared, key: str, text: str, last: bool):
    def run(batches):
        special, cache = shared.value, {}
        for batch in batches:
            at = batch.schema.get_field_index(text)
            texts, known = batch.column(at).to_pylist(), batch.column("_known").to_pylist()
            counts = [0] * len(texts)
            for i, hint in enumerate(_hinted(batch.column(at))):
                if not hint:
                    continue
                found = entities(texts[i])
                own = dict(zip(known[i][::2], known[i][1::2]))
                own.update({f"{k}|{e}": special[k, e] for _, _, k, e in found if (k, e) in special})
                if not last:
                    known[i] = [x for pair in own.items() for x in pair]
                    continue
                parts, end = [], 0
                for a, b, kind, entity in found:
                    made = own.get(f"{kind}|{entity}") or cache.get((kind, entity))
                    if made is None:
                        made = surrogate(key, kind, entity)
                        if len(cache) < 100_000:
                            cache[kind, entity] = made
                    parts += [texts[i][end:a], shaped(kind, made, texts[i][a:b])]
                    end = b
                texts[i] = "".join([*parts, texts[i][end:]])
                counts[i] = len(found)
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            columns[batch.schema.get_field_index("_known")] = pa.array(
                known, pa.list_(pa.string()))
            columns[batch.schema.get_field_index("_n")] = pa.array(counts, pa.int64())
            yield pa.record_batch(columns, schema=pa.schema(
                [pa.field(f.name, c.type) for f, c in zip(batch.schema, columns)]))
    return run


def _rewritten(docs: DataFrame, key: str, text: str, most: int) -> DataFrame:
    """`docs` with replaced text and, as last column _n, the number of mentions."""
    spark = docs.sparkSession
    special = exceptions(docs, key, text)
    blocks = max(1, -(-special.count() // most))
    rows = docs.withColumn("_known", F.array().cast("array<string>")).withColumn(
        "_n", F.lit(0).cast("bigint"))
    for k in range(blocks):
        part = special.where(F.pmod(F.xxhash64("kind", "entity"), F.lit(blocks)) == k)
        block = {(r.kind, r.entity): r.made for r in part.collect()}     # about `most` rows
        if k:
            rows = written(rows, "rewriting")
        rows = rows.mapInArrow(_rewriter(spark.sparkContext.broadcast(block), key, text,
                                         k == blocks - 1), rows.schema)
    return rows.drop("_known")


def surrogates(docs: DataFrame, key: str = KEY, doc_id: str = "doc_id", text: str = "text",
               most: int = EXCEPTIONS) -> DataFrame:
    """doc_id, the text with surrogates, and n_found mentions."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return _rewritten(rows, key, "text", most).withColumnRenamed("_n", "n_found")


def replaced(docs: DataFrame, key: str = KEY, text: str = "text",
             most: int = EXCEPTIONS) -> DataFrame:
    """The documents with surrogates in their text and all other columns as they are."""
    names = {f"_c{i}": name for i, name in enumerate(docs.columns)}
    rows = _rewritten(docs.toDF(*names), key, f"_c{docs.columns.index(text)}", most)
    return rows.select(*names).toDF(*names.values())
