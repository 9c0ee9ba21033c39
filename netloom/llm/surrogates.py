"""Replace personal data by keyed, type-consistent surrogates.

Every entity (e-mail address, telephone number, payment card, IPv4 address, bank account,
social security number, personal name) is mapped by a keyed hash of its normal form: the
same person or number gets the same surrogate in every document, with the format, letter
case, script and gender of the original. The distinct entities of the corpus are checked
before the texts are rewritten: if a surrogate is shared by two entities, or is an entity of
the corpus itself, all but the first of them draw again until none collides. So different
entities stay different.
"""

import hashlib
import hmac
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm.common import map_texts, renamed, table
from netloom.plans.sizing import durable

# Redrawn entities up to this number (some 100 bytes each) go to the tasks as a lookup.
SMALL = 50_000

# Common given names by script and gender.
GIVEN = {
    ("latin", "f"): "Anna Maria Emma Laura Julia Sophie Claire Camille Lucía Carmen Elena Sara Marta Katrin Ingrid Alice Emily Susan Linda Mary".split(),
    ("latin", "m"): "John Peter Paul Thomas Michael David Hans Karl Stefan Pierre Jean Louis Antoine Carlos Miguel José Pablo James Robert William".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Юлия".split(),
    ("cyrillic", "m"): "Иван Пётр Алексей Дмитрий Сергей Андрей Михаил Николай Владимир Павел".split(),
}
# Titles behind which names stand.
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Monsieur Madame Mme Señor Señora Sra Господин Госпожа".split()
_SYLLABLES = {
    "latin": [c + v for c in "bdfghklmnprstvwz" for v in "aeiou"],
    "cyrillic": [c + v for c in "бвгдзклмнпрст" for v in "аеиоу"],
}
_ENDINGS = {
    ("latin", ""): ["n", "r", "s", "l", "ng", "rd", "tt", "sen"],
    ("cyrillic", "m"): ["ов", "ев", "ин"],
    ("cyrillic", "f"): ["ова", "ева", "ина"],
    ("cyrillic", ""): ["енко", "чук"],
}
_GENDER = {name: (script, gender) for (script, gender), names in GIVEN.items() for name in names}
_PATTERN = re.compile(
    r"(?P<email>(?<![\w.%+-])[\w.%+-]{1,64}+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+)"
    r"|(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
    r"|(?P<ip>(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<card>(?<![\w.-])\d{4}(?:[\x20-]?\d{4}){2}[\x20-]?\d{1,7}(?![\w-]))"
    r"|(?P<phone>(?<![\w.])(?:\+\d{1,3}[\x20.-]?\(?\d{1,4}\)?(?:[\x20.-]?\d{2,4}){2,4}"
    r"|\(\d{3}\)\x20?\d{3}[.-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\w))"
    rf"|(?P<title>(?<!\w)(?:{'|'.join(TITLES)})\.?)\x20(?P<titled>[^\W\d_a-zа-яё]\w+(?:[\x20-][^\W\d_a-zà-ÿа-яё]\w+){{0,2}})"
    rf"|(?P<named>(?<!\w)(?:{'|'.join(sorted(_GENDER))})(?:\x20[^\W\d_a-zà-ÿа-яё]\w+){{1,2}})"
)


def _digits() -> str:
    """A class of all that the pattern's ``\\d`` matches; in other regex libraries that is ASCII only."""
    found = re.finditer(r"\d+", "".join(map(chr, range(0x110000))))
    return "[" + "".join(f"{m[0][0]}-{m[0][-1]}" for m in found) + "]"


_D = _digits()
# What a text with an entity holds at least; a fast test before the pattern above.
_HINT = rf"@|{_D}{{3}}|\+{_D}|[A-Z]{{2}}{_D}{{2}}|{_D}\.{_D}{{1,3}}\.|(?:{'|'.join(TITLES)})\.? |(?:{'|'.join(sorted(_GENDER))}) "


def _luhn(digits: str) -> int:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10


def _script(word: str) -> str:
    return "cyrillic" if "Ѐ" <= word[:1] <= "ӿ" else "latin"


def normal(kind: str, text: str) -> str:
    """The form under which mentions of one entity agree."""
    if kind in ("phone", "card", "ssn"):
        return re.sub(r"\D", "", text)
    if kind == "iban":
        return text.replace(" ", "").upper()
    return text.lower()


def _stream(key: bytes, *parts):
    """Endless keyed random numbers below 65536."""
    count = 0
    while True:
        block = hmac.digest(key, "\x1f".join([*map(str, parts), str(count)]).encode("utf-8", "surrogatepass"), hashlib.sha256)
        for i in range(0, 32, 2):
            yield block[i] * 256 + block[i + 1]
        count += 1


def _shaped(text: str, draw) -> str:
    """Digits become digits and letters become letters of the same case."""
    out = []
    for k, c in enumerate(text):
        if c.isdigit():
            out.append(str(1 + next(draw) % 9) if k == 0 and c != "0" else str(next(draw) % 10))
        elif c.isalpha():
            letter = chr((0x430 if _script(c) == "cyrillic" else 97) + next(draw) % 26)
            out.append(letter.upper() if c.isupper() else letter)
        else:
            out.append(c)
    return "".join(out)


def surrogate(key: bytes, kind: str, entity: str, attempt: int = 0, gender: str = "") -> str:
    """The normal form of an entity's replacement. Later attempts give other ones."""
    draw = _stream(key, kind, entity, attempt, gender)
    while True:
        out = _draw(kind, entity, attempt, gender, draw)
        if out != entity:
            return out


def _draw(kind, entity, attempt, gender, draw):
    if kind == "email":
        local, _, domain = entity.rpartition("@")
        labels = domain.split(".")
        reserved = labels[-2:-1] == ["example"]
        host = domain if reserved else _shaped(labels[0], draw) + ".example." + labels[-1]
        shaped = _shaped(local, draw)
        return shaped + (str(next(draw)) if attempt > 2 or shaped == local else "") + "@" + host
    if kind == "ip":
        return ".".join(str(1 + next(draw) % 254) for _ in range(4))
    if kind == "card":
        body = _shaped(entity[:-1], draw)
        tail = next(t for t in "0123456789" if _luhn(body + t) == 0)
        return body + (tail if _luhn(entity) == 0 else str((int(tail) + 1 + next(draw) % 9) % 10))
    if kind == "iban":
        body = _shaped(entity[4:], draw).upper()
        number = "".join(str(int(c, 36)) for c in body + entity[:2] + "00")
        return f"{entity[:2]}{98 - int(number) % 97:02d}{body}"
    if kind == "given":
        names = GIVEN[(_script(entity), gender or "fm"[next(draw) % 2])]
        out = names[next(draw) % len(names)].lower()
        return out if not attempt else out + "".join(_syllable(entity, draw) for _ in range((attempt + 3) // 4))
    if kind == "surname":
        script = _script(entity)
        ends = _ENDINGS.get((script, gender)) or _ENDINGS[(script, "")]
        out = "".join(_syllable(entity, draw) for _ in range(2 + (attempt + 3) // 4))
        return out + ends[next(draw) % len(ends)]
    return _shaped(entity, draw)


def _syllable(like, draw):
    syllables = _SYLLABLES[_script(like)]
    return syllables[next(draw) % len(syllables)]


def _written(kind: str, mention: str, form: str) -> str:
    """A surrogate's normal form in the way its mention was written."""
    if kind in ("phone", "card", "ssn", "iban"):
        chars = iter(form)
        return "".join(next(chars) if c.isalnum() else c for c in mention)
    if kind == "email":
        return form.upper() if mention.isupper() else form
    return form.upper() if mention.isupper() and len(mention) > 1 else form[:1].upper() + form[1:] if mention[:1].isupper() else form


def _country(mention: str) -> int:
    """Digits of the country code, which a surrogate keeps."""
    found = re.match(r"\+(\d{1,3})[\x20.(-]", mention)
    return len(found[1]) if found else 0


def _ending_gender(surname: str) -> str:
    """Gender that a surname shows: Cyrillic ones do."""
    if _script(surname) == "latin":
        return ""
    return "f" if surname[-1].lower() in "ая" else "m"


# A word that may be a name.
_WORD = re.compile(r"[^\W\d_a-zà-ÿа-яё]\w+")


def _again(text: str, found: list, names: dict) -> list:
    """``found`` and the further stand-alone mentions of its names, which are the same entities."""
    out, k = [], 0
    for w in _WORD.finditer(text):
        name = names.get(w[0].lower())
        if name is None or w.start() and re.match(r"\w", text[w.start() - 1]):
            continue
        while k < len(found) and found[k][1] <= w.start():
            k += 1
        if k == len(found) or found[k][0] >= w.end():
            out.append((*w.span(), *name))
    return sorted(found + out) if out else found


def mentions(text: str) -> list:
    """(start, end, kind, normal form, gender) of the entities of a text, in order and apart.

    A name found behind a title or given name counts wherever else it stands in the text.
    """
    out, names = [], {}
    for m in _PATTERN.finditer(text):
        kind = m.lastgroup
        if kind in ("titled", "named"):
            begin = m.start("titled") if kind == "titled" else m.start()
            for w in re.finditer(r"\w+", m[kind]):
                what = "given" if w[0] in _GENDER else "surname"
                gender = _GENDER[w[0]][1] if what == "given" else _ending_gender(w[0])
                out.append((begin + w.start(), begin + w.end(), what, normal(what, w[0]), gender))
                if w[0] not in TITLES and (what == "given" or w[0].lower() not in names):
                    names[w[0].lower()] = out[-1][2:]
        else:
            out.append((*m.span(), kind, normal(kind, m[0]), str(_country(m[0])) if kind == "phone" else ""))
    return _again(text, out, names) if names else out


class Replacer:
    """Rewrites texts; ``again`` maps (kind, entity, gender) to the attempt of a redrawn entity."""

    def __init__(self, key: bytes, again: dict | None = None, limit: int = 100_000):
        self.key, self.again, self.made, self.limit = key, again or {}, {}, limit

    def form(self, kind, entity, gender, attempt=None):
        if attempt is None:
            attempt = self.again.get((kind, entity, gender), 0)
        known = (kind, entity, gender, attempt)
        if known not in self.made:
            if len(self.made) >= self.limit:
                self.made = {}
            keep = int(gender) if kind == "phone" and gender else 0
            self.made[known] = entity[:keep] + surrogate(self.key, kind, entity[keep:], attempt, "" if kind == "phone" else gender)
        return self.made[known]

    def rewrite(self, text: str, own: dict | None = None) -> tuple:
        """(new text, spans in it as kind:start:end, number of mentions)."""
        out, spans, at, shift = [], [], 0, 0
        for start, end, kind, entity, gender in mentions(text):
            attempt = (own or {}).get((kind, entity, gender))
            new = _written(kind, text[start:end], self.form(kind, entity, gender, attempt))
            out += [text[at:start], new]
            spans.append(f"{kind}:{start + shift}:{start + shift + len(new)}")
            shift += len(new) - (end - start)
            at = end
        return ("".join([*out, text[at:]]) if spans else text), ",".join(spans), len(spans)


def _entities():
    def of(texts):
        hint = pc.match_substring_regex(texts, _HINT).to_pylist()
        rows = [sorted({"\x1f".join(e[2:]) for e in mentions(t.as_py())}) if h else [] for t, h in zip(texts, hint)]
        return (pa.array(rows, pa.list_(pa.string())),)

    return of


def entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The distinct (kind, entity, gender) of all texts."""
    found = map_texts(docs.select(F.col(text_col).alias("text")), "text", "found array<string>", _entities, keep=[])
    each = found.select(F.explode("found").alias("e"))
    parts = F.split("e", "\x1f")
    return each.select(*[F.get(parts, F.lit(k)).alias(c) for k, c in enumerate(("kind", "entity", "gender"))]).distinct()


def _forms(rows: DataFrame, key: bytes) -> DataFrame:
    """Adds ``form``, the surrogate of (kind, entity, gender, attempt)."""
    def run(batches):
        replacer = Replacer(key)
        for batch in batches:
            forms = [replacer.form(r["kind"], r["entity"], r["gender"], r["attempt"]) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(forms, pa.string())], names=[*batch.schema.names, "form"])

    return rows.mapInArrow(run, "kind string, entity string, gender string, attempt int, form string")


def redrawn(found: DataFrame, key: bytes) -> DataFrame | None:
    """Entities that need another attempt than the first, with that ``attempt``; None if there are none.

    Two mentions of an entity that differ in gender count as two. Each round looks at the
    surrogates of all entities: of those that share one the first keeps it, and none keeps
    one that is an entity of the corpus. The others draw again.
    """
    current = durable(_forms(found.withColumn("attempt", F.lit(0)), key), "surrogates")
    originals = found.select("kind", F.col("entity").alias("form")).distinct()
    changed = False
    while True:
        first = current.groupBy("kind", "form").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("entity", "gender")).alias("first"))
        shared = first.filter(F.col("n") > 1)
        real = first.join(originals, ["kind", "form"], "left_semi").withColumn("real", F.lit(True))
        bad = shared.withColumn("real", F.lit(False)).unionByName(real).groupBy("kind", "form").agg(
            F.max("real").alias("real"), F.first("first").alias("first"))
        losers = durable(current.join(bad, ["kind", "form"]).filter(
            F.col("real") | (F.struct("entity", "gender") != F.col("first"))).select("kind", "entity", "gender", "attempt"), "losers")
        if losers.isEmpty():
            return current.filter(F.col("attempt") > 0).select("kind", "entity", "gender", "attempt") if changed else None
        changed = True
        keep = current.join(losers.drop("attempt"), ["kind", "entity", "gender"], "left_anti")
        again = _forms(losers.withColumn("attempt", F.col("attempt") + 1), key)
        current = durable(keep.unionByName(again), "surrogates")


def replace(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """``docs`` with the entities of ``text_col`` replaced, ``n_replaced`` and their ``spans`` in the new text.

    All other columns and texts without an entity stay as they are; a null text stays null.
    Equal rows give equal rows. ``spans`` is kind:start:end by start, comma-joined, in code
    points with exclusive ends. Columns of ``docs`` named like a new one are replaced.
    """
    again = redrawn(durable(entities(docs, text_col), "entities"), key)
    lookup, carried = {}, ()
    if again is not None:
        some = again.limit(SMALL + 1).collect()
        if len(some) <= SMALL:
            lookup = {(r["kind"], r["entity"], r["gender"]): r["attempt"] for r in some}
        else:  # too many for a lookup: join them to the texts that mention them
            docs, carried = _with_attempts(docs, again, text_col), ("__again",)
    shared = docs.sparkSession.sparkContext.broadcast(lookup)

    def make():
        replacer = Replacer(key, shared.value)

        def of(texts, missing, *own):
            hint = pc.match_substring_regex(texts, _HINT).to_pylist()
            attempts = own[0].to_pylist() if own else [None] * len(texts)
            rows = []
            for text, h, mine in zip(texts, hint, attempts):
                mine = {tuple(m.split("\x1f")[:3]): int(m.split("\x1f")[3]) for m in mine or []}
                rows.append(replacer.rewrite(text.as_py(), mine) if h else (None, "", 0))
            new = pa.array([r[0] for r in rows], pa.string())
            texts = pc.if_else(missing, pa.scalar(None, pa.string()), pc.coalesce(new, texts))
            return texts, pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())

        return of

    names = [c for c in docs.columns if c not in ("spans", "n_replaced", "__again")]
    given = docs.withColumn("__missing", F.col(f"`{text_col}`").isNull())
    out = map_texts(given, text_col, f"`{text_col}` string, spans string, n_replaced long", make, ("__missing", *carried), names)
    return out.select(*[F.col(f"`{c}`") for c in names], "n_replaced", "spans")


def rewrite(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """``docs`` with the entities of ``text_col`` replaced and no other change."""
    inner, back = renamed(docs)
    return back(replace(inner, key, f"c{docs.columns.index(text_col)}"))


def _with_attempts(docs: DataFrame, again: DataFrame, text_col: str) -> DataFrame:
    """Adds ``__again``: the redrawn entities a text mentions."""
    digest = F.sha2(F.col(text_col), 256)
    found = map_texts(docs.select(digest.alias("digest"), F.col(text_col).alias("text")), "text", "found array<string>", _entities, keep=["digest"])
    each = found.select("digest", F.explode("found").alias("e")).distinct()
    tag = again.select(F.concat_ws("\x1f", "kind", "entity", "gender").alias("e"), F.col("attempt").cast("string").alias("attempt"))
    mine = each.join(tag, "e").groupBy("digest").agg(F.collect_list(F.concat_ws("\x1f", "e", "attempt")).alias("__again"))
    return docs.join(mine, digest == mine["digest"], "left").drop("digest")


# Used by the registered query; a real run passes its own.
DEMO_KEY = b"netloom-demo-key"


def op1_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return replace(docs, DEMO_KEY).select("doc_id", "text", "n_replaced", "spans")
