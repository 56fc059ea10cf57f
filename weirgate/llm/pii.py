r"""Personal data by candidate gradient boosting, in DataFrame operations only.

1. Generators: one pattern for each kind, of high recall, propose spans; those of different kinds may overlap. A text is cut
   at a pattern's matches; lengths of the pieces, summed up in two levels, give the spans' places, and the pieces next to a
   match give its context, so that no step is more than linear in the text.
2. Base kinds (email, ip, card, phone) that pass their check always stay.
3. Every other candidate gets features of format and context and a probability from boosted trees, which are trained on
   labelled sentences that a generator writes; features are made by the same expressions in training and in use. A kind's
   threshold is the lowest one that reaches `PRECISION` on the calibration part.
4. Candidates over their threshold are added by decreasing score, each unless it overlaps a base span or one added before.
   Spans are sorted once and compared along their order, so that only runs of overlapping candidates are compared in pairs.
   `redact` replaces the union of the base spans and of all candidates over their threshold by their kinds' marks.

Defined results: null is the empty text: no spans. Repeated rows give repeated results; other columns are ignored, whatever
their names. Places are code points, from 0, end exclusive. Texts are read whole, whatever their length.
"""

from __future__ import annotations

import json
import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosting
from .common import documents, text_of

# The kinds in order. Patterns use possessive repeats where what follows can't start inside the repeat, which
# changes no match and keeps the search linear and free of recursion.
BASE = ("email", "ip", "card", "phone")
EXTRA = ("secret", "ssn", "iban", "local_phone", "email_words")
KINDS = BASE + EXTRA
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "local_phone": r"(?<![0-9+])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])",
    "email_words": r"(?i)(?<![a-z0-9._-])[a-z0-9._-]{1,64}+\x20?[\[(]?\x20?at\x20?[\])]?\x20?[a-z0-9-]{1,63}+\x20?[\[(]\x20?dot\x20?[\])]\x20?[a-z]{2,10}+",
}
#: What a text, in lower case, must contain for a pattern to be tried: cheap, and true of every text with a match.
NEEDS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-", "email_words": "dot"}
#: What a match must contain to be a candidate.
MUST = {"secret": "[0-9]"}
PRECISION = 0.95
_BLOCK = 128
_BEFORE, _AFTER = 32, 16


def _with_running(rows: DataFrame, out: str, xs: str | Column, zero: int, op: str) -> DataFrame:
    """Adds the column `out`: folds of the elements before each element of xs by an associative op of a and x, in SQL; null for null and for no elements.

    Blocks of _BLOCK are folded first, then inside them, so that no long array is copied often. Arrays that a lambda reads
    are columns which it reads twice or more: one that is read once would be computed anew for every element.
    """
    zero = f"CAST({zero} AS BIGINT)"

    def running(xs: str, first: str) -> str:
        return f"aggregate({xs}, named_struct('at', {first}, 'out', CAST(array() AS array<bigint>)), (acc, x) -> named_struct('at', {op.format(a='acc.at', x='x')}, 'out', array_append(acc.out, acc.at)), acc -> acc.out)"

    blocks = f"transform(sequence(0, CAST(floor((size(__xs) - 1) / {_BLOCK}) AS INT)), b -> slice(__xs, b * {_BLOCK} + 1, {_BLOCK}))"
    folds = f"transform({blocks}, ys -> aggregate(ys, {zero}, (a, x) -> {op.format(a='a', x='x')}))"
    folded = F.expr(f"CASE WHEN size(__xs) > 0 THEN flatten(zip_with({blocks}, {running(folds, zero)}, (ys, first) -> {running('ys', 'first')})) END")
    return rows.withColumn("__xs", F.expr(xs) if isinstance(xs, str) else xs).withColumn(out, folded).drop("__xs")


_SUM, _LARGER, _SMALLER = "{a} + {x}", "greatest({a}, {x})", "least({a}, {x})"


def _heads(starts: Column, ends: Column) -> Column:
    """Places of the elements that start at or after the ends so far."""
    return F.filter(F.transform(F.zip_with(starts, ends, lambda s, e: s >= e), lambda new, i: F.when(new, i)), lambda i: i.isNotNull())


_CANDIDATE = "array<struct<kind:int,start:bigint,end:bigint,match:string,before:string,after:string,from:bigint,to:bigint>>"


#: Of the i-th match m of a kind: its place, from the sums __s and the pieces __g around the matches, its context, and its place in bytes.
_PLACED = (
    "transform(__m, (m, i) -> named_struct('kind', {kind}, 'start', __s[i] + length(__g[i]), 'end', __s[i] + length(__g[i]) + length(m), 'match', m,"
    " 'before', right(__g[i], {before}), 'after', left(__g[i + 1], {after}), 'from', __b[i] + octet_length(__g[i]), 'to', __b[i] + octet_length(__g[i]) + octet_length(m)))"
)


def _candidates(df: DataFrame) -> DataFrame:
    """Adds a column c_<kind> for each kind: its matches in the column __text, with place and context."""
    for number, kind in enumerate(KINDS):
        text, pattern = F.col("__text"), PATTERNS[kind]
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        low = F.lower(text) if pattern.startswith("(?i)") else text
        df = df.withColumn("__m", F.when(F.contains(low, F.lit(NEEDS[kind])), found) if kind in NEEDS else found)
        df = df.withColumn("__g", F.when(F.size("__m") > 0, F.split(text, pattern, -1)))
        for out, of in (("__s", "length"), ("__b", "octet_length")):
            df = _with_running(df, out, f"zip_with(slice(__g, 1, size(__m)), __m, (g, m) -> CAST({of}(g) + {of}(m) AS BIGINT))", 0, _SUM)
        made = _PLACED.format(kind=number, before=_BEFORE, after=_AFTER)
        if kind in MUST:
            made = f"filter({made}, c -> c.match RLIKE '{MUST[kind]}')"
        df = df.withColumn(f"c_{kind}", F.expr(f"CASE WHEN size(__m) > 0 THEN {made} ELSE CAST(array() AS {_CANDIDATE}) END")).drop("__m", "__g", "__s", "__b")
    return df


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Of a string of at most a few dozen digits."""
    doubled = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, c: Column) -> Column:
    """The base check of a match."""
    match, digits = c.match, _digits(c.match)
    if kind == "ip":
        part = "0*+(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])?"
        return match.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


FEATURES = ("kind", "length", "digits", "letters", "upper", "distinct", "groups", "luhn", "hex", "says_secret", "says_phone", "says_account", "says_person", "says_code", "quoted", "assigned", "wordy_before", "wordy_after", "digit_before", "at_dot")


def _features(c: Column) -> list[Column]:
    """Numbers for one candidate, in the order of FEATURES."""
    match, before, after = c.match, c.before, c.after
    n = F.length(match).cast("double")
    digits = F.length(_digits(match))
    says = lambda words: before.rlike(rf"(?i)\b(?:{words})\w{{0,3}}\b[^.!?\n]*$").cast("double")
    return [
        c.kind.cast("double"), n, digits / n, F.length(F.regexp_replace(match, "[^A-Za-z]", "")) / n, F.length(F.regexp_replace(match, "[^A-Z]", "")) / n,
        F.size(F.array_distinct(F.split(match, ""))) / n, F.length(F.regexp_replace(match, r"[^\x20().-]", "")).cast("double"),
        F.when(digits.between(12, 19), _luhn(_digits(match)).cast("double")).otherwise(0.0), match.rlike("^[0-9a-f]+$").cast("double"),
        says("token|secret|api|key|passw|pwd|auth|bearer|credential|credentials|password"), says("phone|tel|call|mobile|fax|cell|dial|contact|reach"), says("iban|account|bank|transfer"), says("ssn|social|security|tax|passport|insurance"),
        says("version|order|invoice|commit|isbn|hash|sha|build|ref|id|article|model|serial|sku|part|page|checksum|file"), before.rlike("[\"'`]$").cast("double"), before.rlike(r"[=:]\s*[\"'`]?$").cast("double"),
        before.rlike(r"\w$").cast("double"), after.rlike(r"^\w").cast("double"), before.rlike(r"[0-9][^a-zA-Z]{0,2}$").cast("double"), match.rlike(r"(?i)[\[(]\s?at\s?[\])]").cast("double"),
    ]


# ---- training sentences


def _sentences(rng: random.Random, count: int) -> list[tuple[str, int, int]]:
    """(sentence, label, kind number): each holds one candidate of the kind, which is personal data or secret if the label is 1."""
    word = lambda: "".join(rng.choice("aeioulrnstdmpc") for _ in range(rng.randint(2, 9)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    pick = lambda s, n: "".join(rng.choice(s) for _ in range(n))
    hexa, mixed = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    out = []
    for _ in range(count):
        kind = rng.choice(EXTRA)
        good = rng.random() < 0.5
        cue = ""
        if kind == "secret":
            value = pick(hexa, rng.choice([32, 40, 64])) if rng.random() < 0.5 else pick(mixed, rng.randint(18, 60))
            if good:
                name = rng.choice(["token", "secret", "api_key", "key", "password", "auth token", "access_key", "client secret", "passwd", "bearer"])
                cue = f"{name}{rng.choice([' = ', '=', ': ', ' : ', ' is ', ' '])}{rng.choice(['', chr(34), chr(39)])}"
            else:
                value = rng.choice([value, f"{word()}-{word()}-{digits(4)}-{word()}", f"{word()}/{word()}/{word()}{digits(3)}", digits(rng.randint(16, 30)), "a1" * rng.randint(9, 30), word() * 4 + "1"])
                cue = rng.choice(["commit ", "sha ", "checksum: ", "file ", "hash = ", "build ", "page ", "", "", ""])
        elif kind == "ssn":
            value = f"{digits(3)}-{digits(2)}-{digits(4)}"
            cue = rng.choice(["ssn ", "ssn: ", "social security number ", "social security ", "tax id "]) if good else rng.choice(["order ", "part ", "isbn ", "serial ", "invoice ", "version ", "model "])
        elif kind == "iban":
            value = pick("ABCDEFGHIJKLMNOPRSTUVZ", 2) + digits(2) + " " + " ".join(digits(4) for _ in range(rng.randint(3, 5))) + rng.choice(["", " " + digits(2)])
            if rng.random() < 0.5:
                value = value.replace(" ", "")
            if good:
                cue = rng.choice(["iban ", "iban: ", "bank account ", "transfer to ", "account ", ""])
            else:
                value = rng.choice([value, pick("ABCDEFGHIJKLM", 2) + digits(2) + "".join(pick("ABCDEFGHIJKLMNOP", 4) for _ in range(3))])
                cue = rng.choice(["serial ", "model ", "sku ", "part ", "order "])
        elif kind == "local_phone":
            s = rng.choice(" .-")
            value = f"{rng.choice(['(%s)', '%s'])}" % digits(3) + s + digits(3) + s + digits(4)
            if good:
                cue = rng.choice(["phone ", "call ", "tel: ", "mobile ", "call me at ", "fax ", "contact "])
            else:
                value = rng.choice([value, f"{digits(4)} {digits(3)} {digits(3)}", f"{digits(2)}.{digits(3)}.{digits(3)}"])
                cue = rng.choice(["order ", "version ", "part ", "ref ", "", "", f"{digits(3)} "])
        else:
            at = rng.choice([" [at] ", " (at) ", "[at]", " [ at ] "]) if good else rng.choice([" at ", " [at] "])
            value = f"{word()}{rng.choice(['.' + word(), digits(2), ''])}{at}{word()}{rng.choice([' [dot] ', ' (dot) ', '[dot]']) if good or at == ' at ' else ' (dot) '}{rng.choice(['com', 'org', 'net']) if good else word()[:9]}"
            if not good:
                cue = rng.choice(["see ", "look ", ""])
        out.append((f"{words(0, 8)} {cue}{value}{rng.choice(['', chr(34), '.', ','])} {words(0, 6)}", int(good), KINDS.index(kind)))
    return out


#: Sentences that the trees are trained on, and their random seed.
TRAINING_SENTENCES, SEED = 3000, 23


def _fitted(rows: list) -> tuple[boosting.Trees, dict[int, float]]:
    rows = np.array(rows, float)
    x, y = rows[:, 1:], rows[:, 0]
    trees = boosting.train(x, y, rounds=25, depth=3)
    held = np.arange(len(y)) % 4 == 3
    p = trees.margin(x[held])
    thresholds = {}
    for k in range(len(BASE), len(KINDS)):
        of = x[held][:, 0] == k
        order = np.sort(p[of])
        good = [t for t in order if y[held][of][p[of] >= t].mean() >= PRECISION]
        thresholds[k] = float(good[0]) if good else float("inf")
    return trees, thresholds


_MODELS: dict[tuple, tuple[boosting.Trees, dict[int, float]]] = {}


def model(spark: SparkSession, count: int = TRAINING_SENTENCES, seed: int = SEED) -> tuple[boosting.Trees, dict[int, float]]:
    """Trees and the log-odds threshold of each extra kind, trained once in a process. The sentences go in as one literal: the session runs no Python for them."""
    if (count, seed) not in _MODELS:
        rows = [{"t": t, "y": y, "k": k} for t, y, k in _sentences(random.Random(seed), count)]
        table = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), "array<struct<t:string,y:int,k:int>>")).alias("r")).select(F.col("r.t").alias("__text"), "r.y", "r.k")
        made = _candidates(table.withColumn("__text", F.coalesce("__text", F.lit("")))).select("y", "k", F.explode(F.concat(*(f"c_{k}" for k in EXTRA))).alias("c")).where("c.kind = k")
        got = made.select(F.array(F.col("y").cast("double"), *_features(F.col("c"))).alias("v")).collect()
        _MODELS[count, seed] = _fitted(sorted(r.v for r in got))
    return _MODELS[count, seed]


# ---- use


def _overlaps(a: Column, b: Column) -> Column:
    return (a.start < b.end) & (b.start < a.end)


_SPAN = "struct<start:bigint,kind:int,end:bigint>"


def _span(c: Column) -> Column:
    return F.struct(c.start.alias("start"), c.kind.alias("kind"), c.end.alias("end"))


def _with_free(rows: DataFrame, base: str, candidates: str) -> DataFrame:
    """Replaces the column `candidates` (start, kind, end, score) by those of them that overlap no span of the column `base`, in order.

    Both are sorted together. Before a candidate, the largest end of a base span so far shows an overlap; after it, the next base span's start does.
    """
    far = (1 << 62) - 1
    tagged = F.concat(
        F.transform(base, lambda b: F.struct(b.start.alias("start"), F.lit(0).alias("tag"), b.kind.alias("kind"), b.end.alias("end"), F.lit(0.0).alias("score"))),
        F.transform(candidates, lambda c: F.struct(c.start.alias("start"), F.lit(1).alias("tag"), c.kind.alias("kind"), c.end.alias("end"), c.score.alias("score"))),
    )
    busy = (F.size(base) > 0) & (F.size(candidates) > 0)
    rows = rows.withColumn("__all", F.when(busy, F.array_sort(tagged)))
    rows = _with_running(rows, "__before", "transform(__all, x -> IF(x.tag = 0, x.end, CAST(-1 AS BIGINT)))", -1, _LARGER)
    rows = _with_running(rows, "__after", f"transform(reverse(__all), x -> IF(x.tag = 0, x.start, {far}L))", far, _SMALLER)
    judged = F.zip_with(F.zip_with("__all", "__before", lambda x, t: F.struct(x.alias("x"), ((x.tag == 1) & (t <= x.start)).alias("free"))), F.reverse("__after"), lambda r, t: F.struct(r.x.alias("x"), (r.free & (t >= r.x.end)).alias("free")))
    plain = F.transform(F.filter(judged, lambda r: r.free), lambda r: F.struct(r.x.start.alias("start"), r.x.kind.alias("kind"), r.x.end.alias("end"), r.x.score.alias("score")))
    return rows.withColumn(candidates, F.when(busy, plain).otherwise(F.col(candidates))).drop("__all", "__before", "__after")


def _best(run: Column) -> Column:
    """Of candidates in one run of overlaps: by decreasing score, then start and kind, each that overlaps none chosen before."""
    ranked = F.transform(F.array_sort(F.transform(run, lambda x: F.struct((-x.score).alias("worse"), _span(x).alias("s")))), lambda x: x.s)
    chosen = F.aggregate(ranked, F.array().cast(f"array<{_SPAN}>"), lambda acc, s: F.when(F.exists(acc, lambda o: _overlaps(o, s)), acc).otherwise(F.array_append(acc, s)))
    return F.when(F.size(run) > 1, chosen).otherwise(F.transform(run, _span))


def _with_added(rows: DataFrame, base: str, candidates: str, out: str) -> DataFrame:
    """Adds the column `out`: spans of the candidates (start, kind, end, score, in order) that overlap neither a base span nor a better one that was chosen."""
    rows = _with_free(rows, base, candidates)
    there = F.size(candidates) > 0
    rows = _with_running(rows, "__to", F.transform(candidates, lambda x: x.end), -1, _LARGER)
    # Where a candidate starts at or after all ends so far, a new run of overlaps begins: only inside a run can one exclude another.
    rows = rows.withColumn("__heads", F.when(there, _heads(F.transform(candidates, lambda x: x.start), F.col("__to"))))
    nexts = F.concat(F.slice("__heads", 2, F.size("__heads")), F.array(F.size(candidates)))
    runs = F.zip_with("__heads", nexts, lambda h, k: F.slice(F.col(candidates), h + 1, k - h))
    return rows.withColumn(out, F.when(there, F.flatten(F.transform(runs, _best))).otherwise(F.array().cast(f"array<{_SPAN}>"))).drop("__to", "__heads")


def _scored(df: DataFrame, id_col: str, text_col: str, keep) -> DataFrame:
    """doc_id, the columns in keep, __base (checked candidates of the base kinds, in order) and __y (c, score: candidates over their threshold)."""
    trees, thresholds = model(df.sparkSession)
    rows = df.select(F.col(id_col).cast("bigint").alias("doc_id"), *keep, F.coalesce(text_of(df, text_col), F.lit("")).alias("__text"))
    rows = _candidates(rows)
    checked = lambda k: F.filter(f"c_{k}", lambda c: _valid(k, c))
    rows = rows.withColumn("__base", F.concat(*(F.transform(checked(k), _whole_span) for k in BASE)))
    rows = rows.withColumn("__base", F.when(F.size("__base") > 1, F.array_sort("__base")).otherwise(F.col("__base")))
    # The trees run where there is a candidate; most texts have none.
    rows = rows.withColumn("__x", F.concat(*(f"c_{k}" for k in EXTRA)))
    limit = lambda kind: F.coalesce(*(F.when(kind == k, F.lit(t)) for k, t in thresholds.items()))
    rows = rows.withColumn("__f", F.transform("__x", lambda c: F.struct(_whole_span(c).alias("c"), F.array(*_features(c)).alias("f"))))
    scored = F.expr(f"transform(__f, x -> named_struct('c', x.c, 'score', {trees.sql(lambda k: f'x.f[{k}]')}))")
    rows = rows.withColumn("__y", F.when(F.size("__x") > 0, scored))
    rows = rows.withColumn("__y", F.coalesce(F.filter("__y", lambda x: x.score >= limit(x.c.kind)), F.array().cast(f"array<struct<c:{_WHOLE},score:double>>")))
    return rows.drop("__text", "__x", "__f", *(f"c_{k}" for k in KINDS))


_WHOLE = "struct<start:bigint,kind:int,end:bigint,from:bigint,to:bigint>"


def _whole_span(c: Column) -> Column:
    """A span with its place in bytes."""
    return F.struct(c.start.alias("start"), c.kind.alias("kind"), c.end.alias("end"), c["from"].alias("from"), c["to"].alias("to"))


def find(df: DataFrame, id_col="doc_id", text_col="text", keep=()) -> DataFrame:
    """doc_id, the columns in keep, base, spans and every (also candidates over their threshold that overlap others): arrays of (start, kind, end), by start and then kind."""
    rows = _scored(df, id_col, text_col, keep)
    rows = rows.withColumn("base", F.transform("__base", _span))
    some = F.size("__y") > 0
    rows = rows.withColumn("every", F.when(some, F.array_sort(F.concat("base", F.transform("__y", lambda x: _span(x.c))))).otherwise(F.col("base")))
    rows = rows.withColumn("__c", F.array_sort(F.transform("__y", lambda x: F.struct(x.c.start.alias("start"), x.c.kind.alias("kind"), x.c.end.alias("end"), x.score.alias("score")))))
    rows = _with_added(rows, "base", "__c", "__added")
    return rows.withColumn("spans", F.when(some, F.array_sort(F.concat("base", "__added"))).otherwise(F.col("base"))).drop("__base", "__y", "__c", "__added")


def listed(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s.kind], s.start.cast("string"), s.end.cast("string"))), ",")


def redact(df: DataFrame, text_col="text", id_col="doc_id") -> DataFrame:
    """The same columns, with spans that overlap merged and replaced by [KIND] of the first; null texts stay null.

    The text is cut in bytes, where a piece costs its own length only.
    """
    names = df.columns
    row = F.struct(*(F.col(n).alias(f"c{i}") for i, n in enumerate(names)))
    packed = df.select(row.alias("__row"), F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__t"))
    rows = _scored(packed, "__id", "__t", [F.col("__row"), F.col("__t")])
    rows = rows.withColumn("__all", F.array_sort(F.concat("__base", F.transform("__y", lambda x: x.c))))
    there = F.size("__all") > 0
    rows = _with_running(rows, "__to", "transform(__all, s -> s.to)", 0, _LARGER)
    rows = rows.withColumn("__heads", F.when(there, _heads(F.transform("__all", lambda s: s["from"]), F.col("__to"))))
    rows = rows.withColumn("__bytes", F.when(there, F.col("__t").cast("binary")))
    marks = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    def piece(h: Column) -> Column:
        """The text between the run of spans before and this one, and this one's mark."""
        end = F.col("__to")[h]
        between = F.substring(F.col("__bytes"), (end + 1).cast("int"), (F.col("__all")[h]["from"] - end).cast("int"))
        return F.concat(between.cast("string"), marks[F.col("__all")[h].kind])

    last = F.array_max(F.transform("__all", lambda s: s["to"]))
    rest = F.substring(F.col("__bytes"), (last + 1).cast("int"), F.octet_length("__bytes")).cast("string")
    text = F.when(there, F.concat(F.array_join(F.transform("__heads", piece), ""), rest)).otherwise(F.col("__t"))
    return rows.select(*(text.alias(n) if n == text_col else F.col("__row").getField(f"c{i}").alias(n) for i, n in enumerate(names)))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(documents(spark, sf_dir))
    count = lambda k: F.size(F.filter("base", lambda s: s.kind == KINDS.index(k))).cast("bigint").alias(f"n_{k}")
    return found.select("doc_id", *map(count, BASE), F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))
