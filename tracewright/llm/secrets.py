"""Secret scans, in DataFrame functions only.

Three pattern kinds, and a battery of randomness tests over every long token:

* chi-squared: repeats of symbols against a uniform draw from the alphabet of the inferred encoding,
* runs: Wald-Wolfowitz over symbols in the upper and lower half of the alphabet,
* serial correlation of neighbouring symbols.

False discoveries are controlled twice, by Benjamini-Hochberg among the tokens of a length class, so short tokens compete
with short ones only: a token leaves if the battery (Bonferroni over its three tests) discovers that it is not random, and
of what stays a token is a secret if it is discovered not to be written text, by its runs of letters, capitals and digits and
by its repeats of symbols. All of it is row by row but for two histograms, so no text meets another in a task.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm._shared import settle, work_dir

#: Kinds in order, their patterns and shortest match (of the value for the first, else of the whole).
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
# every match of these two is a whole run, so the shortest length can stand in the pattern
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
#: Alphabets in symbol order.
ALPHABETS = {"hex": "0123456789abcdef", "HEX": "0123456789ABCDEF", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "lower36": "0123456789abcdefghijklmnopqrstuvwxyz",
             "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}
#: Upper ends of the length classes.
LENGTH_CLASSES = (24, 32, 40, 48, 64, 96)
#: Share of neighbours of different kind in written tokens, chance that two letters of a text are equal, and how the
#: variance of equal pairs grows with the cube of the length (4 * (sum p^3 - (sum p^2)^2) for letters drawn as in English,
#: half as much again since letters of a text are not independent).
TEXT_SWITCH, TEXT_REPEAT, TEXT_SPREAD = 0.08, 0.0667, 0.006
_BINS = 200
_MARK = "\x01"
#: Items that are taken together where arrays are built one by one: what is copied grows with n * n / CHUNK.
_CHUNK = 256
_SPAN = "struct<s:int,k:int,e:int>"
_TESTED = "struct<s:int,k:int,e:int,token:string>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _collected(items: Column, zero: Column, step: Callable[[Column, Column], Column], kind: str) -> Column:
    """Struct (at, out) after ``step(acc, item)`` over all items; ``step`` gives ``at`` and the array ``out`` with what it adds.
    Arrays grow within a chunk, and by whole chunks, so long inputs are not copied for every item."""
    empty = F.array().cast(f"array<{kind}>")
    part = lambda at, xs: F.aggregate(xs, F.struct(at.alias("at"), empty.alias("out")), step)
    chunks = lambda xs: F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / _CHUNK).cast("int"))

    def more(xs: Column) -> Callable[[Column, Column], Column]:
        return lambda acc, i: _let(part(acc["at"], F.slice(xs, i * _CHUNK + 1, _CHUNK)), lambda r: F.struct(r["at"].alias("at"), F.array_append(acc["out"], r["out"]).alias("out")))

    start = F.struct(zero.alias("at"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    whole = lambda xs: _let(F.aggregate(chunks(xs), start, more(xs)), lambda r: F.struct(r["at"].alias("at"), F.flatten(r["out"]).alias("out")))
    return _let(items, lambda xs: F.when(F.size(xs) <= _CHUNK, part(zero, xs)).otherwise(whole(xs)))


def _spans(text: Column, pattern: str, kind: int, keep: Callable[[Column], Column] | None = None, token: bool = False) -> Column:
    """Matches of a pattern as array<struct<s, k, e>> (code points, end exclusive), with the match if ``token``. Matches are
    set between marks and the text is split there, so odd parts are matches and lengths give positions."""
    item = _TESTED if token else _SPAN
    parts = F.split(F.regexp_replace(text, pattern, f"{_MARK}$0{_MARK}"), _MARK, -1)

    def step(acc: Column, part: Column) -> Column:
        begin = acc["at"]["at"]
        end = begin + F.length(part)
        span = F.struct(begin.alias("s"), F.lit(kind).alias("k"), end.alias("e"), *([part.alias("token")] if token else []))
        ok = acc["at"]["odd"] if keep is None else acc["at"]["odd"] & keep(part)
        return F.struct(F.struct(end.alias("at"), (~acc["at"]["odd"]).alias("odd")).alias("at"), F.when(ok, F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.lit(False).alias("odd"))
    return _let(parts, lambda p: F.when(F.size(p) > 1, _collected(p, zero, step, item)["out"]).otherwise(F.array().cast(f"array<{item}>")))


def _apart(long: Column, base: Column) -> Column:
    """The spans of ``long`` (in order, none overlaps the next) that overlap none of ``base``; a chunk looks at the base spans
    about it only."""
    def chunk(xs: Column, bs: Column) -> Callable[[Column], Column]:
        def one(i: Column) -> Column:
            return _let(F.slice(xs, i * _CHUNK + 1, _CHUNK), lambda part: _let(
                F.filter(bs, lambda b: (b["s"] < F.element_at(part, -1)["e"]) & (part[0]["s"] < b["e"])),
                lambda near: F.filter(part, lambda x: ~F.exists(near, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))))

        return one

    chunks = lambda xs: F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / _CHUNK).cast("int"))
    return F.when((F.size(long) == 0) | (F.size(base) == 0), long).otherwise(_let(long, lambda xs: _let(base, lambda bs: F.flatten(F.transform(chunks(xs), chunk(xs, bs))))))


def _upper_tail(z: Column) -> Column:
    """Normal tail, logistic approximation; far out an exponential bound, so it never rounds to 0."""
    far = F.exp(-z * z / 2) / F.greatest(z, F.lit(1.0)) / 2.5066
    return F.when(z > 5, F.greatest(far, F.lit(1e-300))).otherwise(1 / (1 + F.exp(0.07056 * z * z * z + 1.5976 * z)))


def battery(token: Column) -> Column:
    """Struct of ``p_random`` (small: not random), ``p_text`` (small: not text) and ``length_class``; null under two symbols."""
    total = lambda arr: F.aggregate(arr, F.lit(0.0), lambda a, x: a + x)
    pair = lambda arr, f: total(F.zip_with(F.slice(arr, F.lit(1), F.size(arr) - 1), F.slice(arr, F.lit(2), F.size(arr) - 1), f))
    kind = lambda c: F.when(c.between("0", "9"), 0).when(c.between("A", "Z"), 1).when(c.between("a", "z"), 2).otherwise(3)

    def read(v: Column) -> Column:
        encoding = F.when(v.rlike("^[0-9a-f]+$"), ALPHABETS["hex"]).when(v.rlike("^[0-9A-F]+$"), ALPHABETS["HEX"])
        encoding = encoding.when(v.rlike("^[A-Z2-7]+$"), ALPHABETS["base32"]).when(v.rlike("^[0-9a-z]+$"), ALPHABETS["lower36"]).otherwise(ALPHABETS["base64"])
        symbols = F.filter(F.split(v, ""), lambda c: c != "")
        return F.when(F.length(v) >= 2, _let(F.struct(v.alias("v"), encoding.alias("a"), symbols.alias("c")), place))

    def place(t: Column) -> Column:
        n, m = F.size(t["c"]).cast("double"), F.length(t["a"]).cast("double")
        at = F.transform(t["c"], lambda c: (F.call_function("locate", c, t["a"]) - 1).cast("double"))
        squares = total(F.transform(F.array_distinct(t["c"]), lambda c: F.pow(n - F.length(F.replace(t["v"], c, F.lit(""))), F.lit(2)).cast("double")))
        switches = pair(F.transform(t["c"], kind), lambda a, b: (a != b).cast("double"))
        return _let(F.struct(n.alias("n"), m.alias("m"), at.alias("x"), squares.alias("sq"), switches.alias("switches")), count)

    def count(t: Column) -> Column:
        m = t["m"]
        hi = total(F.transform(t["x"], lambda x: (x >= m / 2).cast("double")))
        runs = 1 + pair(t["x"], lambda a, b: ((a >= m / 2) != (b >= m / 2)).cast("double"))
        serial = pair(t["x"], lambda a, b: (a - (m - 1) / 2) * (b - (m - 1) / 2))
        return _let(F.struct(t["n"].alias("n"), m.alias("m"), t["sq"].alias("sq"), t["switches"].alias("switches"), hi.alias("hi"), runs.alias("runs"), serial.alias("serial")), judge)

    def judge(t: Column) -> Column:
        n, m, sq, hi = t["n"], t["m"], t["sq"], t["hi"]
        z_chi = (sq * m / n - n - (m - 1)) / F.sqrt(2 * (m - 1) * (n - 1) / n)
        lo = n - hi
        mean = 2 * hi * lo / n + 1
        spread = F.sqrt(F.greatest((mean - 1) * (mean - 2) / (n - 1), F.lit(1e-9)))
        z_runs = F.when((hi == 0) | (lo == 0), F.sqrt(n)).otherwise(F.abs(t["runs"] - mean) / spread)
        z_serial = F.abs(t["serial"]) / ((m * m - 1) / 12 * F.sqrt(n - 1))
        p_random = F.least(F.lit(1.0), 3 * F.least(_upper_tail(z_chi), 2 * _upper_tail(z_runs), 2 * _upper_tail(z_serial)))
        z_switch = (t["switches"] - TEXT_SWITCH * (n - 1)) / F.sqrt((n - 1) * TEXT_SWITCH * (1 - TEXT_SWITCH))
        repeats = n * (n - 1) * TEXT_REPEAT
        z_repeat = (repeats - (sq - n)) / F.sqrt(2 * repeats + TEXT_SPREAD * n * n * n)
        p_text = F.least(F.lit(1.0), 2 * F.least(_upper_tail(z_switch), _upper_tail(z_repeat)))
        length_class = F.lit(len(LENGTH_CLASSES))
        for i in reversed(range(len(LENGTH_CLASSES))):
            length_class = F.when(n <= LENGTH_CLASSES[i], i).otherwise(length_class)
        return F.struct(p_random.alias("p_random"), p_text.alias("p_text"), length_class.cast("int").alias("length_class"))

    return _let(F.translate(F.rtrim(token, F.lit("=")), "-_", "+/"), read)


def false_discovery_cuts(tests: DataFrame, p: str, q: float) -> dict[int, float]:
    """Benjamini-Hochberg by length class: the largest p with p * tests <= q * (tests at or under p). Over a grid of powers
    of two by quarters, so what is counted is bounded, whatever the number of tokens."""
    grid = F.least(F.floor(-F.log2(p) * 4), F.lit(_BINS)).cast("int")
    counts = tests.groupBy("length_class", grid.alias("bin")).agg(F.count("*").alias("n"), F.max(p).alias("p"))
    w = Window.partitionBy("length_class")
    ranked = counts.withColumn("tests", F.sum("n").over(w)).withColumn("found", F.sum("n").over(w.orderBy(F.desc("bin"))))
    best = ranked.filter(F.col("p") * F.col("tests") <= q * F.col("found")).groupBy("length_class").agg(F.max("p").alias("p"))
    return {r["length_class"]: r["p"] for r in best.collect()}  # one row for each length class at most


def _limit(cuts: dict[int, float], length_class: Column) -> Column:
    """The cut of a length class; under all p if it has none."""
    if not cuts:
        return F.lit(-1.0)
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in cuts.items() for x in kv)), length_class), F.lit(-1.0))


def _scanned(docs: DataFrame, columns: list[str], text: str, q: float, alpha: float) -> DataFrame:
    """``_row`` (struct of the columns), ``_base`` and ``_spans``."""
    spark, root = docs.sparkSession, work_dir(docs.sparkSession, "secrets")
    # the mark is no symbol of any pattern; one that stands in a text becomes another such character
    clean = F.translate(F.coalesce(F.col(text), F.lit("")), _MARK, "\x02")
    value = lambda part: F.length(F.regexp_extract(part, ASSIGN, 2)) >= ASSIGN_LEAST
    found = docs.select(F.struct(*(F.col(c) for c in columns)).alias("_row"), clean.alias("_t")).select(
        "_row", F.array_sort(F.concat(_spans(F.col("_t"), ASSIGN, 0, value), _spans(F.col("_t"), ACCESS, 1), _spans(F.col("_t"), HEX, 2))).alias("_base"), _spans(F.col("_t"), TOKEN, 3, token=True).alias("_long"))
    tested = lambda x: F.struct(F.struct(*(x[c].alias(c) for c in "ske")).alias("span"), battery(x["token"]).alias("p"))
    found = found.select("_row", "_base", F.filter(F.transform(_apart(F.col("_long"), F.col("_base")), tested), lambda x: x["p"].isNotNull()).alias("_long"))
    found = settle(found, f"{root}/found")
    tests = found.select(F.explode("_long").alias("x")).select("x.p.*")
    odd = false_discovery_cuts(tests, "p_random", alpha)
    cuts = false_discovery_cuts(tests.filter(F.col("p_random") > _limit(odd, F.col("length_class"))), "p_text", q)
    passes = lambda p: (p["p_random"] > _limit(odd, p["length_class"])) & (p["p_text"] <= _limit(cuts, p["length_class"]))
    extra = F.transform(F.filter("_long", lambda x: passes(x["p"])), lambda x: x["span"])
    return found.select("_row", "_base", F.array_sort(F.concat("_base", extra)).alias("_spans"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", q: float = 0.01, alpha: float = 0.001) -> DataFrame:
    """Spans of secrets in whole texts: ``key``, ``base`` and ``spans`` (arrays of s, k, e by start and kind; k indexes KINDS).

    Null and empty texts have no spans. Repeated rows are judged alike and give a row each; an empty table gives none; other
    columns do not matter. Random tokens that overlap a pattern's span are not added again. ``alpha`` is the false-discovery
    rate of tokens that leave as not random, ``q`` that of tokens that are reported. Texts may be long.
    """
    return _scanned(docs, [key], text, q, alpha).select(F.col(f"_row.`{key}`").alias(key), F.col("_base").alias("base"), F.col("_spans").alias("spans"))


def written(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """Counts by kind, the hash of the pattern spans and all spans of each document (see ``scan``). The texts are read, not kept."""
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return scan(docs).select("doc_id", *(count(i).alias(f"n_{KINDS[i]}") for i in range(3)), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


#: Gaps between masked spans that are cut out of the text one by one; of more, the text is taken apart once.
_FEW = 64


def mask(docs: DataFrame, replacement: str = "[secret]") -> DataFrame:
    """``docs`` with every span of every text replaced (overlapping spans by one mark). Rows and other columns stay; null texts
    stay null; a column n_chars follows the new text, if there is one. No join: rows are written once with their spans."""
    text = F.col("_row.text")

    def step(acc: Column, x: Column) -> Column:
        gap = F.struct(acc["at"].alias("a"), x["s"].alias("b"))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(x["s"] >= acc["at"], F.array_append(acc["out"], gap)).otherwise(acc["out"]).alias("out"))

    def joined(piece: Callable[[Column, Column], Column]) -> Callable[[Column], Column]:
        return lambda r: F.array_join(F.concat(F.transform(r["out"], lambda g: piece(g["a"], g["b"] - g["a"])), F.array(piece(r["at"], F.length(text)))), replacement)

    by_points = lambda r: _let(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), lambda points: joined(lambda a, n: F.array_join(F.slice(points, a + 1, n), ""))(r))
    cut = lambda r: F.when(F.size(r["out"]) <= _FEW, joined(lambda a, n: F.substring(text, a + 1, n))(r)).otherwise(by_points(r))
    masked = F.when(F.size("_spans") == 0, text).otherwise(_let(_collected(F.col("_spans"), F.lit(0), step, "struct<a:int,b:int>"), cut))
    new = {"text": F.col("_masked"), "n_chars": F.length("_masked")}
    found = _scanned(docs, docs.columns, "text", 0.01, 0.001).select("_row", masked.alias("_masked"))
    return found.select(*(new.get(f.name, F.col(f"_row.`{f.name}`")).cast(f.dataType).alias(f.name) for f in docs.schema.fields))
