"""Secret scan with built-in functions only.

Three patterns give the base spans. Beside them, candidate strings (long runs of token
characters) are searched with a sliding window: the window's Shannon entropy is kept
from counts that change by the one character that enters and the one that leaves, and is
compared with a threshold of the candidate's character class. Allow-listed candidates
are left out, and windows that touch an allow-listed string.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions.features import let
from netloom.llm.common import table


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token")) + "|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
# A shorter value is no secret, but its match still takes its characters.
ASSIGN = rf"""({_KEYS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 6
# A run too short for a secret holds no match at all, so the least length stands in the pattern.
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex")

WINDOW = 20
CANDIDATE = f"[A-Za-z0-9+/_=-]{{{WINDOW},}}"
# (class, pattern of a candidate of that class, least entropy in bits); the first that fits counts.
CLASSES = (
    ("entropy_hex", "^[0-9a-fA-F]+$", 3.0),
    ("entropy_upper", "^[0-9A-Z]+$", 3.4),
    ("entropy_alnum", "^[0-9A-Za-z]+$", 3.7),
    ("entropy_base64", "^", 3.9),
)
ALLOWED = (
    "^[^0-9]+$",  # words and identifiers
    "^[0-9_=+/-]+$",  # numbers, dates, rules
    "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",  # UUIDs
)
# Strings that no window with a secret holds; those of one entry have one length.
LISTED = ("EXAMPLE|example", "0123456789", "abcdefgh|ABCDEFGH|xxxxxxxx|XXXXXXXX")
FILLER = "#"  # stands for their characters; no candidate holds it
# Steps of a fold whose results are gathered in a list of their own, so that no long list is copied at each step.
STRIP = 256


def located(text: Column, pattern: str, found: Column, kind: int, keep: Column) -> Column:
    """Structs (start, kind, end) of all matches ``found`` of a pattern; ``keep`` says which of them count."""
    between = F.split(text, pattern, -1)
    step = lambda acc, x: F.struct(
        (acc["pos"] + F.length(x["gap"]) + F.length(x["hit"])).alias("pos"),
        F.concat(acc["out"], F.array(F.struct(
            (acc["pos"] + F.length(x["gap"])).alias("start"), F.lit(kind).alias("kind"),
            (acc["pos"] + F.length(x["gap"]) + F.length(x["hit"])).alias("end"),
            x["hit"].alias("hit"), x["keep"].alias("keep")))).alias("out"))
    zipped = F.arrays_zip(F.slice(between, 1, F.size(found)).alias("gap"), found.alias("hit"), keep.alias("keep"))
    span = "struct<start:int,kind:int,end:int,hit:string,keep:boolean>"
    none = F.expr(f"CAST(array() AS array<{span}>)")
    starts = F.sequence(F.lit(1), F.greatest(F.size(found), F.lit(1)), F.lit(STRIP))
    strips = let(zipped, lambda z: F.transform(starts, lambda a: F.slice(z, a, STRIP)))

    def walk(acc, strip):
        inner = F.aggregate(strip, F.struct(acc["pos"].alias("pos"), none.alias("out")), step)
        return let(inner, lambda w: F.struct(w["pos"].alias("pos"), F.concat(acc["out"], F.array(w["out"])).alias("out")))

    walked = F.aggregate(strips, F.struct(F.lit(0).alias("pos"), F.expr(f"CAST(array() AS array<array<{span}>>)").alias("out")), walk)
    return F.when(F.size(found) > 0, F.filter(F.flatten(walked["out"]), lambda s: s["keep"])).otherwise(none)


def is_path(value: Column) -> Column:
    """Paths and slugs: words of small letters between single separators, digits in the last one only.

    Without a repeated group, whose matching needs a stack as deep as the path has parts.
    """
    digits = lambda c: F.length(c) - F.length(F.translate(c, "0123456789", ""))
    last = F.substring_index(F.translate(value, "_-", "//"), "/", -1)
    return value.rlike("^[a-z0-9/_-]+$") & value.rlike("^/?[a-z]+[/_-]") & ~value.rlike("[/_-][/_-]") & (digits(value) == digits(last))


def without_listed(value: Column, listed=LISTED) -> Column:
    """A candidate with the characters of listed strings replaced, one for one."""
    for strings in listed:
        value = F.regexp_replace(value, strings, FILLER * len(strings.split("|")[0]))
    return value


def high_windows(value: Column, least: Column, window: int = WINDOW) -> Column:
    """Struct (first, last): the first and last window of a string whose entropy in bits is ``least`` or more; -1 if none.

    A window is named by its last character. The fold holds the counts of the characters '+'
    to 'z', the sum of n * log2(n) over them, the window's characters and the place of the
    last filler; one step changes two counts and the matching two terms of the sum, so the
    work grows with the length. Windows that hold filler do not count.
    """
    import math

    letters = ord("z") - ord("+") + 1
    term = F.array(*[F.lit(n * math.log2(n) if n else 0.0) for n in range(window + 2)])
    codes = F.transform(F.split(value, ""), lambda c, i: F.struct(F.greatest(F.ascii(c) - ord("+"), F.lit(-1)).alias("enter"), i.alias("i")))

    def put(counts, place, value):
        return F.concat(F.slice(counts, F.lit(1), place), F.array(value), F.slice(counts, place + 2, F.lit(letters)))

    def step(acc, x):
        leave = F.get(acc["recent"], F.lit(0))
        same = x["enter"] == leave
        up, down = F.get(acc["counts"], x["enter"]), F.get(acc["counts"], leave)
        gained = F.when(x["enter"] >= 0, F.get(term, up + 1) - F.get(term, up)).otherwise(0.0)
        lost = F.when(leave >= 0, F.get(term, down) - F.get(term, down - 1)).otherwise(0.0)
        total = acc["sum"] + F.when(same, 0.0).otherwise(gained - lost)
        entered = F.when(x["enter"] >= 0, put(acc["counts"], x["enter"], up + 1)).otherwise(acc["counts"])
        counts = F.when(same, acc["counts"]).when(leave < 0, entered).otherwise(let(entered, lambda c: put(c, leave, down - 1)))
        filler = F.when(x["enter"] < 0, x["i"]).otherwise(acc["filler"])
        entropy = F.round(math.log2(window) - total / window, 6)
        high = (x["i"] >= window - 1) & (x["i"] - filler >= window) & (entropy >= least)
        recent = F.concat(F.slice(acc["recent"], 2, window - 1), F.array(x["enter"]))
        return F.struct(counts.alias("counts"), total.alias("sum"), recent.alias("recent"), filler.alias("filler"),
                        F.when(high & (acc["first"] < 0), x["i"]).otherwise(acc["first"]).alias("first"),
                        F.when(high, x["i"]).otherwise(acc["last"]).alias("last"))

    start = F.struct(F.array_repeat(F.lit(0), letters).alias("counts"), F.lit(0.0).alias("sum"),
                     F.array_repeat(F.lit(-1), window).alias("recent"), F.lit(-window).alias("filler"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))
    return F.aggregate(codes, start, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes=CLASSES, allowed=ALLOWED,
         listed=LISTED) -> DataFrame:
    """Spans of every whole text as array ``found`` of (start, kind number, end), in order.

    Kind numbers 0 to 2 are ``KINDS``, the following ones are ``classes``. An entropy span
    reaches from the first to the last window of a candidate that passes the threshold.
    Positions are code points, the end is exclusive. A null or empty text has no spans;
    ids pass through, null and repeated ones too; other columns are left out.
    """
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    every = lambda found: F.transform(found, lambda _: F.lit(True))
    rows = rows.withColumns({
        "assigned": F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(0)),
        "values": F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)),
        "access": F.regexp_extract_all(text, F.lit(ACCESS), F.lit(0)),
        "hex": F.regexp_extract_all(text, F.lit(HEX), F.lit(0)),
        "candidates": F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)),
    })
    suspicious = lambda c: ~c.rlike("|".join(f"(?:{a})" for a in allowed)) & ~is_path(c)
    rows = rows.withColumns({
        "base": F.flatten(F.array(
            located(text, ASSIGN, F.col("assigned"), 0, F.transform("values", lambda v: F.length(v) >= ASSIGN_VALUE)),
            located(text, ACCESS, F.col("access"), 1, every(F.col("access"))),
            located(text, HEX, F.col("hex"), 2, every(F.col("hex"))))),
        "runs": located(text, CANDIDATE, F.col("candidates"), 0, F.transform("candidates", suspicious)),
    })

    def class_of(hit, pick):
        chosen = F.lit(pick(len(classes) - 1))
        for k in reversed(range(len(classes) - 1)):
            chosen = F.when(hit.rlike(classes[k][1]), F.lit(pick(k))).otherwise(chosen)
        return chosen

    rows = rows.withColumn("runs", F.transform("runs", lambda r: F.struct(
        r["start"].alias("start"), class_of(r["hit"], lambda k: k + len(KINDS)).alias("kind"),
        # Named first, as a fold would test the class at every step.
        let(class_of(r["hit"], lambda k: classes[k][2]), lambda least: high_windows(without_listed(r["hit"], listed), least)).alias("high"))))
    high = F.transform(F.filter("runs", lambda r: r["high"]["last"] >= 0), lambda r: F.struct(
        (r["start"] + r["high"]["first"] - (WINDOW - 1)).alias("start"), r["kind"].alias("kind"),
        (r["start"] + r["high"]["last"] + 1).alias("end")))
    plain = F.transform("base", lambda s: F.struct(s["start"], s["kind"], s["end"]))
    return rows.select("id", F.array_sort(F.concat(plain, high)).alias("found"))


def joined(spans: Column, names) -> Column:
    name = F.array(*[F.lit(n) for n in names])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"], s["end"])), ",")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    of = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    names = [*KINDS, *[c[0] for c in CLASSES]]
    base = F.filter("found", lambda s: s["kind"] < len(KINDS))
    return found.select(
        F.col("id").alias("doc_id"), of(0), of(1), of(2), F.sha2(joined(base, names), 256).alias("base_sha256"),
        joined(F.col("found"), names).alias("spans"))


def _duck_spans(pattern: str, kind: str, keep: str) -> str:
    """Matches with their places: the pieces between matches and the matches, summed up."""
    p = pattern.replace("'", "''")
    return f"""SELECT doc_id, '{kind}' AS kind, hit, s AS "start", s + length(hit) AS "end" FROM (
  SELECT doc_id, unnest(m) AS hit, unnest(v) AS val, unnest(range(1, len(m) + 1)) AS k,
    list_sum(list_transform(p[1:k], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0)::BIGINT AS s
  FROM (SELECT doc_id, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {2 if kind == 'assign' else 0}) AS v,
    string_split_regex(t, '{p}') AS p FROM d) q) r WHERE {keep}"""


def _oracle() -> str:
    names = [*KINDS, *[c[0] for c in CLASSES]]
    rank = "CASE kind " + " ".join(f"WHEN '{n}' THEN {k}" for k, n in enumerate(names)) + " END"
    pick = lambda i: "CASE " + " ".join(
        f"WHEN regexp_matches(hit, '{c[1]}') THEN {c[i]!r}" for c in CLASSES) + " END"
    digits = lambda c: f"(length({c}) - length(translate({c}, '0123456789', '')))"
    path = ("regexp_matches(hit, '^[a-z0-9/_-]+$') AND regexp_matches(hit, '^/?[a-z]+[/_-]') AND NOT regexp_matches(hit, '[/_-][/_-]')"
            f" AND {digits('hit')} = {digits("string_split(translate(hit, '_-', '//'), '/')[-1]")}")
    plain = "hit"
    for strings in LISTED:
        plain = f"regexp_replace({plain}, '{strings}', '{FILLER * len(strings.split('|')[0])}', 'g')"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
base AS ({_duck_spans(ASSIGN, 'assign', f'length(val) >= {ASSIGN_VALUE}')} UNION ALL
  {_duck_spans(ACCESS, 'access', 'true')} UNION ALL {_duck_spans(HEX, 'hex', 'true')}),
cand AS (SELECT *, row_number() OVER () AS c FROM ({_duck_spans(CANDIDATE, 'x', " AND ".join([*[f"NOT regexp_matches(hit, '{a}')" for a in ALLOWED], f"NOT ({path})"]))})),
plain AS (SELECT c, {plain} AS hit FROM cand),
win AS (SELECT c, w, substr(hit, w, {WINDOW}) AS s FROM plain, unnest(range(1, length(hit) - {WINDOW} + 2)) AS u(w)
  WHERE substr(hit, w, {WINDOW}) NOT LIKE '%{FILLER}%'),
chars AS (SELECT c, w, ch, count(*) AS n FROM (SELECT c, w, unnest(string_split(s, '')) AS ch FROM win) GROUP BY ALL),
bits AS (SELECT c, w, round(log2({WINDOW}) - sum(n * log2(n)) / {WINDOW}, 6) AS h FROM chars GROUP BY ALL),
hot AS (SELECT doc_id, {pick(0)} AS kind, "start" + min(w) - 1 AS "start", "start" + max(w) - 1 + {WINDOW} AS "end"
  FROM cand JOIN bits USING (c) WHERE h >= {pick(2)} GROUP BY c, doc_id, hit, "start"),
every AS (SELECT doc_id, kind, "start", "end", {rank} AS k FROM (SELECT doc_id, kind, "start", "end" FROM base UNION ALL SELECT * FROM hot)),
text AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
  count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || "start" || ':' || "end", ',' ORDER BY "start", k) FILTER (k < {len(KINDS)}) AS b,
  string_agg(kind || ':' || "start" || ':' || "end", ',' ORDER BY "start", k) AS spans FROM every GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN text USING (doc_id)"""


ORACLE = _oracle()
