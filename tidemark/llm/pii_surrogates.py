"""PII surrogates, on DataFrame functions alone: detected entities get keyed replacements of their own kind.

Detection is one regular expression. A replacement is drawn from an HMAC-SHA-256 of the entity under a key: the
same entity gets the same replacement in every document and run (coreference), and letters, digits,
punctuation and length keep their places. By kind:

* email: local part by shape (short ones grow to ten characters), domain by shape from its own HMAC, its ending kept;
* phone: country code kept, other digits drawn; IPv4: four octets drawn; IPv6: its hexadecimal digits drawn;
* card-like number: first digit kept, the rest drawn; a number that passes the Luhn test gets one that does;
* IBAN, social security number: country letters kept, the rest by shape; key, token or password: name kept, value by shape;
* person: titles kept; a given name becomes another of the same gender and script (its list tells; the lists are put in a keyed
  order, so two names never become one), a family name becomes syllables of the same script (Latin, Cyrillic, Greek, Armenian; of
  another script with capitals, Latin), and each word of a name is drawn by itself, so "Ms Smith", "Anna Smith" and "ANNA SMITH"
  stay one family. A family name alone, without title or given name, is not detected.

A card, phone or IBAN is drawn from the number without separators and laid into each spelling of it.

Distinctness is checked over the whole corpus for what is drawn (``canonical``): family names, numbers without separators, emails,
values. Those whose replacement equals another's, or is itself one of the corpus, are drawn again (next attempt, which also lengthens
emails and names) until none is left, and every entity that holds one gets its attempt. Only these are joined back, by a hash of the
text, to the documents that hold them; the others are recomputed in place. A broadcast is of at most ``BROADCAST`` bytes, summed first.

The pattern is linear: every repetition is of one class of characters or bounded (an email's name has at most 64 characters,
a label 63, a host 16 labels), so no text, however long, recurses or backtracks far. There is no default key: whoever knows it can link.

Defined results: a null text stays null, an empty one empty; a text without entities is unchanged; texts of any length are read whole; repeated
rows are changed alike, whatever their ids (null ids too); an empty table gives none; other columns are kept as they are, whatever their names.
"""

from __future__ import annotations

import hashlib
import hmac
import os
import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import materialise

#: Given names by gender and script.
GIVEN = {
    ("latin", "f"): "Alice Anna Beatriz Camille Carmen Chloe Clara Elena Emma Eva Frieda Greta Hanna Ines Julia Laura Lea Lucia Manon Maria Marie Martha Nora Olivia Paula Rosa Sarah Sofia Susanne Teresa Ursula Yvonne",
    ("latin", "m"): "Adam Albert Antoine Bruno Carlos David Diego Emil Felix Franz Georg Henri Hugo Ivan Jakob Javier John Jules Karl Louis Lukas Marc Mateo Michael Nicolas Oscar Pablo Peter Robert Stefan Thomas Victor",
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Ирина Мария Ольга",
    ("cyrillic", "m"): "Антон Борис Виктор Иван Игорь Михаил Олег Сергей",
}
#: Titles by gender.
TITLES = {"f": "Mrs Ms Miss Frau Madame Mme Mlle Señora Sra Госпожа", "m": "Mr Mister Herr Monsieur Señor Sr Господин", "": "Dr Prof"}
SYLLABLES = {"latin": "ba del ga hol ken lin mar nor pel ros sen tal ver win zan mer".split(), "cyrillic": "ба вел га кин лев мар нор пет рос сав тал фер хан чер шин зор".split()}
SYLLABLES |= {"greek": "βα γε δι κο λα με νι πα ρο σι τα φε χο ζα θε ξι".split(), "armenian": "բա գե դի կո լա մե նի պա ռո սի տա ֆե խո զա թե քի".split()}
#: Broadcasts hold at most so many bytes of entities or hashes.
BROADCAST = 16 << 20

_WORD = r"\p{Lu}[\p{L}'’-]+"
_TITLE = "|".join(t for group in TITLES.values() for t in group.split())
_GIVEN = "|".join(x for group in GIVEN.values() for n in group.split() for x in (n, n.upper()))
KINDS = {
    "secret": r"(?i:token|secret|password|passwd|api[_-]?key|access[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9_+/=.-]{6,}[\"']?|(?:AKIA|ASIA)[A-Z0-9]{16}\b|(?:sk|pk|ghp|gho|xoxb)[-_][A-Za-z0-9_-]{16,}|[0-9a-f]{32,}\b",
    "email": r"[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}+\.){1,16}[A-Za-z]{2,24}+",
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ip": r"(?<!\d\.)(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]*\d)",
    "ip6": r"(?=[0-9A-Fa-f:]{0,30}\d)(?:(?:[0-9A-Fa-f]{1,4}+:){7}[0-9A-Fa-f]{1,4}+|(?:[0-9A-Fa-f]{1,4}+:){1,6}(?::[0-9A-Fa-f]{1,4}+){1,6})(?![\w:])",
    "ssn": r"\d{3}-\d{2}-\d{4}\b",
    "phone": r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}\b|\(\d{3}\) ?\d{3}[ .-]\d{4}\b|\d{3}[ .-]\d{3}[ .-]\d{4}\b",
    "card": r"\d(?:[ -]?\d){12,18}(?!\d)",
    "person": rf"(?:(?:{_TITLE})\.? (?:(?:{_GIVEN}) )?{_WORD}|(?:{_GIVEN}) {_WORD})",
}
PATTERN = r"(?<![\p{L}\p{N}_%+@])(?:" + "|".join(KINDS.values()) + ")"


def _hmac(key: bytes, label: str, message: Column, attempt: Column) -> Column:
    """HMAC-SHA-256 of label, attempt and message, in hex."""
    block = (key if len(key) <= 64 else hashlib.sha256(key).digest()).ljust(64, b"\0")
    inner = F.concat(F.lit(bytearray(b ^ 0x36 for b in block)), F.encode(F.concat(F.lit(label + ":"), attempt.cast("string"), F.lit(":"), message), "utf-8"))
    return F.sha2(F.concat(F.lit(bytearray(b ^ 0x5C for b in block)), F.unhex(F.sha2(inner, 256))), 256)


def _letters(stream: Column) -> Column:
    return F.translate(stream, "0123456789abcdef", "bdfghjklmnprstvz")


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _shaped(text: Column, stream: Column) -> Column:
    """Digits, lower-case and capital letters drawn from a hex stream, other characters kept. Hex text stays hex."""
    hexed, capital = text.rlike("^(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)[\"']?$"), text.rlike("[A-F]")

    def drawn(b: Column) -> Column:
        def char(c: Column, i: Column) -> Column:
            at = i % 64 + F.lit(1)  # the stream's 64 digits over and over
            own = F.substring(b["hex"], at, F.lit(1))
            return (
                F.when(b["hexed"] & c.rlike("[0-9a-fA-F]"), F.when(b["capital"], F.upper(own)).otherwise(own))
                .when(c.between("0", "9"), F.substring(b["digits"], at, F.lit(1)))
                .when(c.rlike(r"\p{Ll}"), F.substring(b["small"], at, F.lit(1)))
                .when(c.rlike(r"\p{L}"), F.upper(F.substring(b["small"], at, F.lit(1))))
                .otherwise(c)
            )

        return F.array_join(F.transform(F.split(text, ""), char), "")

    def kinds(x: Column) -> Column:
        return _let(F.struct(x.alias("hex"), F.translate(x, "abcdef", "012345").alias("digits"), _letters(x).alias("small"), hexed.alias("hexed"), capital.alias("capital")), drawn)

    return _let(stream, kinds)


def _number(hexes: Column, start: int, n: int) -> Column:
    return F.conv(F.substring(hexes, start, n), 16, 10).cast("long")


def _luhn(digits: Column) -> Column:
    """The Luhn sum modulo 10 of a string of digits."""
    one = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.coalesce(c.cast("int"), F.lit(0)) * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(one, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10


#: Calling codes have one to three digits, which the digits alone tell.
_COUNTRY = r"^\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"


def _bare(e: Column) -> Column:
    return F.regexp_replace(e, "[ .()-]", "")


def _numbered(e: Column, kind: Column, stream: Column) -> Column:
    """A card, phone or IBAN: drawn without separators, then laid into the spelling."""

    def out(bare: Column) -> Column:
        head = F.when(kind == "card", F.substring(bare, 1, 1)).when(kind == "iban", F.substring(bare, 1, 2)).otherwise(F.regexp_extract(bare, _COUNTRY, 0))
        return _let(F.concat(head, F.substring(_shaped(bare, stream), F.length(head) + 1, F.length(bare))), lambda drawn: laid(bare, drawn))

    def laid(bare: Column, drawn: Column) -> Column:
        last = F.substring(drawn, F.length(drawn), F.lit(1)).cast("int")
        fixed = F.concat(F.substring(drawn, F.lit(1), F.length(drawn) - 1), ((last + 10 - _luhn(drawn)) % 10).cast("string"))
        return _let(F.regexp_replace(F.when((kind == "card") & (_luhn(bare) == 0), fixed).otherwise(drawn), r"^\+", ""), spelt)

    def spelt(new: Column) -> Column:
        at = lambda i: F.length(F.regexp_replace(F.substring(e, F.lit(1), i + 1), "[^A-Za-z0-9]", ""))
        return F.array_join(F.transform(F.split(e, ""), lambda c, i: F.when(c.rlike("[A-Za-z0-9]"), F.substring(new, at(i), F.lit(1))).otherwise(c)), "")

    return _let(_bare(e), out)


def _email(e: Column, key: bytes, attempt: Column) -> Column:
    low = F.lower(e)
    local, domain = F.regexp_extract(low, "^[^@]*", 0), F.regexp_extract(low, "@(.*)\\.[^.]*$", 1)

    def drawn(stream: Column) -> Column:
        grown = F.substring(_letters(F.reverse(stream)), F.lit(1), F.greatest(F.lit(0), F.lit(10) - F.length(local)) + attempt * 4)
        return F.concat(_shaped(local, stream), grown, F.lit("@"), _shaped(domain, _hmac(key, "domain", domain, F.lit(0))), F.regexp_extract(low, "\\.[^.]*$", 0))

    return _let(_hmac(key, "email", low, attempt), drawn)


def _given(w: Column, key: bytes) -> Column:
    """The next given name in the keyed order of its list."""
    pairs = []
    for names in GIVEN.values():
        order = sorted(names.split(), key=lambda name: hmac.new(key, f"given:{name}".encode(), hashlib.sha256).digest())
        pairs += [F.lit(x) for pair in zip(order, order[1:] + order[:1]) for x in pair]
    return F.element_at(F.create_map(*pairs), w)


def _address(e: Column, stream: Column) -> Column:
    """An IPv6 address with other digits; capitals stay capitals."""
    out = _let(stream, lambda x: F.array_join(F.transform(F.split(e, ""), lambda c, i: F.when(c == ":", c).otherwise(F.substring(x, i + F.lit(1), F.lit(1)))), ""))
    return F.when(e.rlike("[A-F]"), F.upper(out)).otherwise(out)


def _person(e: Column, key: bytes, attempt: Column) -> Column:
    words = F.split(e, " ")
    bare = lambda w: F.regexp_replace(w, "\\.$", "")
    n = F.size(words)

    def word(w: Column, i: Column) -> Column:
        title = bare(w).rlike(f"^(?:{_TITLE})$") & (i == 0)
        given = w.rlike(f"^(?:{_GIVEN})$") & (i < n - 1)
        loud = w.rlike(r"^\p{Lu}[\p{Lu}'’-]+$")

        def syllables(script: str) -> Column:
            parts = F.array(*map(F.lit, SYLLABLES[script]))
            join = lambda own: F.array_join(F.transform(F.sequence(F.lit(1), F.lit(4) + attempt), lambda k: F.element_at(parts, (F.conv(F.substring(own, (k - 1) % 64 + 1, F.lit(1)), 16, 10).cast("int") + 1))), "")
            return F.initcap(_let(_hmac(key, "family", F.lower(w), attempt), join))

        family = F.when(given, _given(F.initcap(w), key))
        for script in ("cyrillic", "greek", "armenian"):
            family = family.when(w.rlike(rf"^\p{{Is{script.capitalize()}}}"), syllables(script))
        drawn = family.otherwise(syllables("latin"))
        return F.when(title, w).when(loud, F.upper(drawn)).otherwise(drawn)

    return F.array_join(F.transform(words, word), " ")


def kind_of(e: Column) -> Column:
    """Which of ``KINDS`` a match is: the first whose whole pattern it fits."""
    out = None
    for kind, rx in KINDS.items():
        test = e.rlike(f"^(?:{rx})$")
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out.otherwise("other")


def _head(e: Column) -> Column:
    return F.regexp_extract(e, r"^(?i:token|secret|password|passwd|api[_-]?key|access[_-]?key)\s*[=:]\s*[\"']?", 0)


def _drawn(kind: Column, e: Column) -> Column:
    """What a replacement of this kind is drawn for, and by which it is told apart."""
    return (
        F.when(kind == "email", F.lower(e))
        .when(kind == "person", F.concat(F.lit("family:"), F.lower(F.element_at(F.split(e, " "), -1))))
        .when(kind.isin("card", "phone", "iban"), F.concat(F.lit("number:"), _bare(e)))
        .when(kind == "ip", e)
        .when(kind == "ip6", F.lower(e))
        .otherwise(F.concat(F.lit("value:"), F.regexp_replace(F.substring(e, F.length(_head(e)) + 1, F.length(e)), "[\"']$", "")))
    )


def canonical(e: Column) -> Column:
    """One text for all entities that are drawn alike: those of a family, and the spellings of an email, number or value."""
    return _let(kind_of(e), lambda kind: _drawn(kind, e))


def surrogate(e: Column, key: bytes, attempt: Column) -> Column:
    """The replacement of one entity."""

    def by(kind: Column) -> Column:
        stream = _hmac(key, "any", F.when(kind.isin("card", "phone", "iban"), _bare(e)).when(kind == "ip6", F.lower(e)).otherwise(e), attempt)
        octets = lambda x: F.concat_ws(".", (_number(x, 1, 4) % 223 + 1).cast("string"), *[(_number(x, 5 + 2 * i, 2)).cast("string") for i in range(3)])
        valued = lambda b: F.concat(b["head"], _shaped(b["value"], _hmac(key, "value", F.regexp_replace(b["value"], "[\"']$", ""), attempt)))
        return (
            F.when(kind == "email", _email(e, key, attempt))
            .when(kind == "ip", _let(stream, octets))
            .when(kind == "ip6", _address(e, stream))
            .when(kind.isin("card", "phone", "iban"), _numbered(e, kind, stream))
            .when(kind == "person", _person(e, key, attempt))
            .otherwise(_let(_head(e), lambda head: _let(F.struct(head.alias("head"), F.substring(e, F.length(head) + 1, F.length(e)).alias("value")), valued)))
        )

    return _let(kind_of(e), by)


#: Put around matches to cut a text at them in one pass; a text that has it is cut in two.
_CUT = "\x01"


def cut(text: Column) -> Column:
    """A text as stretches and entities by turns: odd places (from 0) hold entities."""
    once = F.split(F.regexp_replace(text, f"({PATTERN})", f"{_CUT}$1{_CUT}"), _CUT, -1)
    entities = F.concat(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), F.array(F.lit("")))
    twice = F.flatten(F.zip_with(F.split(text, PATTERN, -1), entities, lambda piece, e: F.array(piece, e)))
    return F.when(text.contains(_CUT), F.slice(twice, F.lit(1), F.size(twice) - 1)).otherwise(once)


def found(text: Column) -> Column:
    """The entities of a text, in order."""
    return F.filter(cut(text), lambda e, i: i % 2 == 1)


def _rewritten(parts: Column, key: bytes, attempts: Column | None) -> Column:
    def one(e: Column, i: Column) -> Column:
        attempt = F.lit(0) if attempts is None else F.coalesce(F.element_at(attempts, canonical(e)), F.lit(0))
        return F.when(i % 2 == 1, surrogate(e, key, attempt)).otherwise(e)

    return F.array_join(F.transform(parts, one), "")


def collisions(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame | None:
    """entity (in canonical form), attempt of those that attempt 0 does not keep apart; None if there are none. Loops until all are distinct."""
    spelt = docs.select(F.explode(found(F.col(text_col))).alias("e")).distinct().groupBy(canonical(F.col("e")).alias("entity")).agg(F.min("e").alias("e"))
    drawn = lambda attempt: ["entity", "e", F.lit(attempt).alias("attempt"), _drawn(kind_of(F.col("e")), surrogate(F.col("e"), key, F.lit(attempt))).alias("out")]
    tried = materialise(spelt.select(*drawn(0)), "pii-entities")
    names = tried.select(F.col("entity").alias("real"))
    settled, again, before, stalled, attempt = tried, None, None, 0, 0
    while True:
        attempt += 1
        shared = settled.groupBy("out").agg(F.min(F.struct("attempt", "entity")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("out").alias("o"), F.col("first.entity").alias("keeper"))
        clash = settled.join(shared, (F.col("out") == F.col("o")) & (F.col("entity") != F.col("keeper"))).select("entity", "e")
        real = settled.join(names, F.col("out") == F.col("real"), "left_semi").select("entity", "e")
        bad = materialise(clash.unionByName(real).distinct(), "pii-again")
        left = bad.count()
        if not left:
            return again
        stalled = stalled + 1 if before is not None and left >= before else 0
        if stalled > 16:
            raise RuntimeError("the corpus holds so many values of a kind that no free surrogates of its format are left")
        before = left
        redrawn = materialise(bad.select(*drawn(attempt)), "pii-entities")
        redone = redrawn.select(F.col("entity").alias("done"))
        settled = settled.join(redone, F.col("entity") == F.col("done"), "left_anti").unionByName(redrawn)
        again = settled.where("attempt > 0").select("entity", "attempt")


def key_of(spark: SparkSession) -> str:
    """The key that ``spark.tidemark.pii.key`` or TIDEMARK_PII_KEY names; where neither does, a random one for this application."""
    return spark.conf.get("spark.tidemark.pii.key", None) or os.environ.get("TIDEMARK_PII_KEY") or _OWN


_OWN = secrets.token_hex(32)


def _light(df: DataFrame, size: Column) -> DataFrame:
    """``df``, to be broadcast if the sum of ``size`` over its rows is within ``BROADCAST``."""
    total = df.agg(F.sum(size + 32)).first()[0] or 0  # 32 bytes for a row beside its value
    return F.broadcast(df) if total <= BROADCAST else df


def replaced(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``docs`` with every entity replaced under ``key``; ``count_col`` adds the number of entities of a text."""
    if not key:
        raise ValueError("surrogates need a key")
    secret = key.encode()
    taken = {c.lower() for c in docs.columns}

    def free(name: str) -> str:
        while name in taken:
            name += "_"
        return name

    parts, tag, attempts = free("parts"), free("tag"), free("attempts")
    column = lambda name: F.col(f"`{name}`")
    text = column(text_col)
    redone = collisions(docs, secret, text_col)
    more = [] if count_col is None else [F.greatest(F.floor(F.coalesce(F.size(column(parts)), F.lit(0)) / 2), F.lit(0)).cast("long").alias(count_col)]
    keep = lambda tries: [_rewritten(column(parts), secret, tries).alias(c) if c == text_col else column(c) for c in docs.columns]
    parted = docs.select("*", cut(text).alias(parts))
    if redone is None:
        return parted.select(*keep(None), *more)
    redone = materialise(redone, "pii-redone")
    held = docs.select(F.md5(text).alias("h"), F.explode(F.array_distinct(F.transform(found(text), canonical))).alias("held")).distinct()
    held = held.join(_light(redone, F.octet_length("entity")), F.col("held") == F.col("entity"))
    held = materialise(held.groupBy("h").agg(F.map_from_entries(F.collect_set(F.struct("entity", "attempt"))).alias("m")), "pii-documents")
    size = F.aggregate(F.map_keys("m"), F.lit(32).cast("long"), lambda total, e: total + F.octet_length(e) + 8)
    named = _light(held, size).select(F.col("h").alias(tag), F.col("m").alias(attempts))
    joined = parted.join(named, F.md5(text) == column(tag), "left")
    return joined.select(*keep(F.coalesce(column(attempts), F.create_map().cast("map<string,int>"))), *more)
