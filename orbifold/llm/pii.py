"""Personal data in texts: high-recall span generators, boosted trees over their candidates, calibrated thresholds.

Everything on the main path is DataFrame functions. Fixed-format spans (:data:`BASE`) always count.
Further generators (:data:`LOOSE`) propose spans that may overlap: values that look like keys and
passwords, telephone and identity numbers without a fixed format, spelled-out mail addresses. Gradient
boosted trees over format and context features score those; a candidate becomes a span where its score
reaches its kind's threshold and no span found before it overlaps it.

No table labels personal data, so the trees are fitted on :data:`EXAMPLES` made-up sentences with and
without such values, and the thresholds are calibrated on a held-out fifth of them.

Null texts count as empty. Positions are code points, ends are exclusive. All patterns are possessive
or bounded, so long runs in texts of any length neither overflow the stack nor backtrack. Equal texts have equal
spans, and repeated rows and ids stay as they are. An empty table gives an empty result. Columns of any name are kept;
:func:`find_spans` alone adds one, ``pii_spans``, and replaces a column of that name.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import let
from .common import unused

_MAIL = "[A-Za-z0-9._%+-]"
#: Fixed-format kinds, in the order in which they are listed: pattern, and the cheap test for texts that can match.
BASE = {
    "email": (rf"(?:\G|(?<!{_MAIL})){_MAIL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", ""),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
}
#: Generators of candidates: kind, pattern.
LOOSE = (
    ("secret", r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{8,}+"),
    ("phone", r"(?<![0-9A-Za-z.+-])\(?[0-9]{3}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}(?![0-9])"),
    ("id", r"(?<![0-9A-Za-z.+-])[0-9]{3}[ -][0-9]{2}[ -][0-9]{4}(?![0-9-])"),
    ("id", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("card", r"(?<![0-9A-Za-z.])[0-9]{13,19}(?![0-9A-Za-z.])"),
    ("email", r"[A-Za-z0-9._%+-]{1,64} ?[\[(](?i:at)[\])] ?[A-Za-z0-9-]{1,63}(?:(?: ?[\[(](?i:dot)[\])] ?|\.)[A-Za-z0-9-]{1,63}){1,9}"),
)
KINDS = ("email", "ip", "card", "phone", "secret", "id")
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Code points before a candidate that its context features see.
CONTEXT = 28
EXAMPLES, TREES, DEPTH = 4_000, 12, 3
#: Share of true spans that a calibrated threshold keeps to among the held-out candidates of its kind.
PRECISION = 0.95
_BLOCK = 256
#: Code points of the chunks that long texts are cut into, so that no place is sought from the beginning.
CHUNK = 4_096
_SPAN = "struct<s:int,k:int,kind:string,e:int,base:boolean>"


def _blocks(items: Column) -> Column:
    """The items (at least one, a column or bound by ``let``) in blocks: an array that grows by one item at a time costs its whole length each time."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / _BLOCK).cast("int")), lambda b: F.slice(items, b * _BLOCK + 1, F.lit(_BLOCK)))


def _scanned(items: Column, state: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """What ``step`` (state, item) -> (state, array<kind>) adds for each of the items (at least one), in their order."""

    def one(s: Column, x: Column) -> Column:
        after, more = step(s["st"], x)
        return F.struct(after.alias("st"), F.concat(s["a"], more).alias("a"))

    def block(s: Column, items: Column) -> Column:
        start = F.struct(s["st"].alias("st"), F.array().cast(f"array<{kind}>").alias("a"))
        return let(F.aggregate(items, start, one), lambda t: F.struct(t["st"].alias("st"), F.concat(s["a"], F.array(t["a"])).alias("a")))

    start = F.struct(state.alias("st"), F.array().cast(f"array<array<{kind}>>").alias("a"))
    return let(items, lambda items: F.aggregate(_blocks(items), start, block, lambda s: F.flatten(s["a"])))


def _chunks(text: Column) -> Column:
    """The chunks of a long text; null for others."""
    return F.when(F.length(text) > 2 * CHUNK, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)))


def _between(text: Column, chunks: Column | None, start: Column, end: Column) -> Column:
    """The code points of a text from ``start`` to ``end``."""
    plain = F.substring(text, start + 1, end - start)
    if chunks is None:
        return plain
    i, j = F.floor(start / CHUNK).cast("int"), F.floor(end / CHUNK).cast("int")
    of = lambda k: F.coalesce(F.try_element_at(chunks, k + 1), F.lit(""))
    over = F.concat(F.substring(of(i), start % CHUNK + 1, F.lit(CHUNK)), F.array_join(F.slice(chunks, i + 2, j - i - 1), ""), F.substring(of(j), F.lit(1), end % CHUNK))
    return F.when(chunks.isNull(), plain).when(i == j, F.substring(of(i), start % CHUNK + 1, end - start)).otherwise(over)


def _matches(text: Column, pattern: str, possible: Column) -> Column:
    """array<struct<s int, e int, m string>> of the leftmost non-overlapping matches in ``text``.

    The text between matches gives their positions; sums run over blocks, so many matches stay cheap."""
    found = F.when(possible, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    gaps = F.when(possible, F.split(text, pattern, -1))
    steps = F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("n"), m.alias("m")))
    steps = F.filter(steps, lambda x: x["m"].isNotNull())

    def placed(steps: Column, at: Column) -> Column:
        span = "array<struct<s:int,e:int,m:string>>"
        start = F.struct(at.cast("int").alias("p"), F.array().cast(span).alias("a"))
        return F.aggregate(
            steps,
            start,
            lambda s, x: F.struct((s["p"] + x["g"] + x["n"]).alias("p"), F.concat(s["a"], F.array(F.struct((s["p"] + x["g"]).alias("s"), (s["p"] + x["g"] + x["n"]).alias("e"), x["m"].alias("m")))).alias("a")),
            lambda s: s["a"],
        )

    def in_blocks(steps: Column) -> Column:
        blocks = _blocks(steps)
        offsets = F.aggregate(
            blocks,
            F.struct(F.lit(0).alias("p"), F.array().cast("array<int>").alias("a")),
            lambda s, x: F.struct(F.aggregate(x, s["p"], lambda p, y: p + y["g"] + y["n"]).alias("p"), F.concat(s["a"], F.array(s["p"])).alias("a")),
            lambda s: s["a"],
        )
        return F.flatten(F.zip_with(blocks, offsets, placed))

    def spans(steps: Column) -> Column:
        short = F.when(F.size(steps) <= _BLOCK, placed(steps, F.lit(0))).otherwise(in_blocks(steps))
        return F.when(F.size(steps) > 0, short).otherwise(F.array().cast("array<struct<s:int,e:int,m:string>>"))

    return let(steps, spans)  # found once, however often they are looked at


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def digit(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int") * (1 + i % 2)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + digit(i)) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    """Whether a match of a fixed-format pattern counts."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _share(m: Column, chars: str) -> Column:
    return F.length(F.regexp_replace(m, f"[^{chars}]", "")) / F.length(m)


def _features(x: Column, text: Column, generator: int, chunks: Column | None) -> Column:
    """Format and context features of a candidate (s, e, m)."""
    before = F.lower(_between(text, chunks, F.greatest(x["s"] - CONTEXT, F.lit(0)), x["s"]))
    return let(before, lambda before: _told(x["m"], before, generator))


def _told(m: Column, before: Column, generator: int) -> Column:
    flag = lambda c: c.cast("double")
    return F.array(
        F.lit(float(generator)),
        F.length(m).cast("double"),
        _share(m, "0-9"),
        _share(m, "A-Z"),
        flag(m.rlike("^[0-9a-f]+$")),
        F.length(F.regexp_replace(m, "(?:[A-Za-z]+|[0-9]+|[^A-Za-z0-9]+)", "x")) / F.length(m),
        _share(m, "/_-"),
        flag(m.rlike("^(?:AKIA|ASIA)[0-9A-Z]{16}$")),
        flag(before.rlike("(?:token|passw(?:or)?d|passwd|pwd|secret|api.?key|auth|bearer|credential)")),
        flag(before.rlike("(?:tel|phone|call|mobile|fax|contact)")),
        flag(before.rlike("(?:ssn|social security|iban|passport|account|tax id)")),
        flag(before.rlike("(?:commit|sha|order|part|isbn|version|build|image|file|lot|serial|model)")),
        flag(before.rlike('[=:]\\s*"?$')),
        flag(m.rlike("^(?:000|666|9)")),
        F.when(m.rlike("^[0-9]{13,19}$"), flag(_luhn(m))).otherwise(F.lit(0.0)),
    )


def _candidates(text: Column, chunks: Column | None = None) -> Column:
    """array<struct<kind, s, e, f>> of all generators; ``chunks`` are those of the text, if known."""

    def part(g: int, kind: str, pattern: str) -> Column:
        possible = text.rlike("[0-9]") if kind != "email" else text.rlike(r"(?i)[\[(]at[\])]")
        return F.transform(
            _matches(text, pattern, possible),
            lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), _features(x, text, g, chunks).alias("f")),
        )

    return F.concat(*(part(g, *x) for g, x in enumerate(LOOSE)))


@dataclass(frozen=True)
class SpanModel:
    """Boosted trees, nested as (feature, bound, low, high) with numbers as leaves, and a threshold for each kind."""

    trees: tuple
    thresholds: dict[str, float]

    def score(self, f: Column) -> Column:
        """Probability that the candidate with the feature array ``f`` is personal data."""

        def of(tree: tuple | float) -> Column:
            if not isinstance(tree, tuple):
                return F.lit(float(tree))
            at, bound, low, high = tree
            return F.when(f[at] <= bound, of(low)).otherwise(of(high))

        return 1 / (1 + F.exp(-2 * reduce(lambda a, b: a + b, [w * of(t) for w, t in self.trees])))


def _parsed(debug: str) -> tuple:
    """The (weight, tree) pairs in Spark's description of a boosted model."""
    lines = [x.strip() for x in debug.splitlines()]
    trees: list = []

    def node(at: int) -> tuple[tuple | float, int]:
        if lines[at].startswith("Predict:"):
            return float(lines[at].split()[1]), at + 1
        _, _, feature, _, bound = lines[at].strip("()").replace("(", "").replace(")", "").split()
        low, at = node(at + 1)
        high, at = node(at + 1)  # skips the line of the opposite test
        return (int(feature), float(bound), low, high), at

    for k, line in enumerate(lines):
        if line.startswith("Tree "):
            trees.append((float(line.split("weight")[1].strip(" ):")), node(k + 1)[0]))
    return tuple(trees)


def examples(spark: SparkSession) -> DataFrame:
    """(id, text, y): made-up sentences around values that are personal (1) or only look so (0)."""
    draw = lambda k, n: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(n)).cast("int")
    hexes = F.sha2(F.col("id").cast("string"), 256)
    upper = F.upper(F.translate(F.substring(F.base64(F.unhex(hexes)), 1, 40), "+/=", "ABC"))
    d = lambda k, n: F.lpad(draw(k, 10**n).cast("string"), n, "1")
    word = lambda k: F.element_at(F.array(*map(F.lit, "river ocean table lantern winter garden market signal copper violet".split())), draw(k, 10) + 1)
    number = lambda wrong: F.concat(F.lit("4"), d(6, 7), d(7, 7), F.pmod(F.filter(F.sequence(F.lit(0), F.lit(9)), lambda c: _luhn(F.concat(F.lit("4"), d(6, 7), d(7, 7), c.cast("string"))))[0] + wrong, F.lit(10)))
    yes = [
        F.concat(F.lit("card "), number(0)),
        F.concat(F.lit('token = "'), F.substring(hexes, 1, 40), F.lit('"')),
        F.concat(F.lit("password="), F.substring(hexes, 1, 18)),
        F.concat(F.lit("the "), F.concat(F.lit("AKIA"), F.substring(upper, 1, 16))),
        F.concat(F.lit("api_key: "), F.substring(F.base64(F.unhex(hexes)), 1, 32)),
        F.concat(F.lit("secret = "), word(3), d(4, 4), word(5)),
        F.concat(F.lit("call me at ("), d(6, 3), F.lit(") "), d(7, 3), F.lit("-"), d(8, 4)),
        F.concat(F.lit("phone: "), d(6, 3), F.lit("-"), d(7, 3), F.lit("-"), d(8, 4)),
        F.concat(F.lit("my ssn is 1"), d(6, 2), F.lit("-"), d(7, 2), F.lit("-"), d(8, 4)),
        F.concat(F.lit("social security number 2"), d(6, 2), F.lit("-"), d(7, 2), F.lit("-"), d(8, 4)),
        F.concat(F.lit("iban DE"), d(9, 2), F.lit(" "), d(6, 4), F.lit(" "), d(7, 4), F.lit(" "), d(8, 4), F.lit(" "), d(5, 4), F.lit(" "), d(4, 2)),
        F.concat(F.lit("write to "), word(3), F.lit(" (at) "), word(4), F.lit(" [dot] org")),
    ]
    no = [
        F.concat(F.lit("number "), number(3)),
        F.concat(word(4), F.lit(" "), d(6, 5), d(7, 4)),
        F.concat(F.lit("commit "), F.substring(hexes, 1, 40)),
        F.concat(F.lit("image file "), word(3), F.lit("_"), d(4, 6)),
        F.concat(F.lit("order 20"), d(4, 2), F.lit("-"), d(5, 7)),
        F.concat(F.lit("part "), F.upper(word(3)), d(4, 5)),
        F.concat(F.lit("version-"), d(4, 1), F.lit("-"), d(5, 1), F.lit("-beta"), d(6, 1)),
        F.concat(F.lit("see "), word(3), F.lit("/"), word(4), F.lit("/20"), d(5, 2), F.lit("/"), word(6)),
        F.concat(F.lit("build 9"), d(4, 2), F.lit("-"), d(5, 2), F.lit("-"), d(6, 4)),
        F.concat(F.lit("lot "), d(4, 3), F.lit("."), d(5, 3), F.lit("."), d(6, 4)),
        F.concat(F.lit("the "), word(3), word(4), d(5, 2), F.lit(" grew")),
        F.concat(F.lit("model GB"), d(9, 2), d(6, 4), d(7, 4), d(8, 4)),
        F.concat(F.lit("on 20"), d(4, 2), F.lit("-"), d(5, 2), F.lit("-"), d(6, 2), F.lit("/"), d(7, 2)),
    ]
    pick = lambda options: F.element_at(F.array(*options), draw(2, len(options)) + 1)
    y = (draw(1, 2) == 1).cast("double")
    told = F.when(y == 1, pick(yes)).otherwise(pick(no))
    return spark.range(0, EXAMPLES, 1, 4).select("id", F.concat(word(10), F.lit(" "), word(11), F.lit(" "), told, F.lit(" "), word(12)).alias("text"), y.alias("y"))


def fit_spans(spark: SparkSession) -> SpanModel:
    """Fits the trees on four fifths of the examples' candidates and calibrates thresholds on the rest.

    The number of examples is fixed, so what reaches the driver (scores of the held-out fifth) is too."""
    rows = examples(spark).select("id", "y", F.explode(_candidates(F.col("text"))).alias("c")).select("id", "y", "c.kind", "c.f").persist()
    train = rows.where("id % 5 <> 0").select("y", array_to_vector("f").alias("x"))
    gbt = GBTClassifier(featuresCol="x", labelCol="y", maxIter=TREES, maxDepth=DEPTH, seed=7, maxBins=32)
    trees = _parsed(gbt.fit(train).toDebugString)
    held = rows.where("id % 5 = 0").select("kind", "y", SpanModel(trees, {}).score(F.col("f")).alias("p")).orderBy("kind", F.desc("p"), "y").collect()
    rows.unpersist()
    thresholds = {k: 2.0 for k in KINDS}
    for kind in KINDS:
        hits = 0.0
        for n, r in enumerate([r for r in held if r.kind == kind], 1):
            hits += r.y
            if hits >= PRECISION * n:
                thresholds[kind] = r.p
    return SpanModel(trees, thresholds)


def find_spans(docs: DataFrame, model: SpanModel, name: str = "pii_spans") -> DataFrame:
    """``docs`` with a column ``name``: array<struct<s int, k int, kind string, e int, base boolean>>, by start and kind.

    A column of that name is replaced. Candidates are taken in order of start, kind and end: one stays where no
    fixed-format span and no candidate that stayed before it overlaps it. Both are found in one pass over sorted spans,
    so time grows with the number of spans but for the sort."""
    kept = [c for c in docs.columns if c.lower() != name.lower()]
    text_, chunks_, fixed_, loose_, free_ = unused([*kept, name], "text_", "chunks_", "fixed_", "loose_", "free_")
    text = F.col(text_)
    rows = docs.select(*kept, F.coalesce(F.col("text").cast("string"), F.lit("")).alias(text_)).withColumn(chunks_, _chunks(text))

    def fixed(kind: str, pattern: str, needs: str) -> Column:
        possible = F.contains(text, F.lit(needs)) if needs else F.lit(True)
        valid = F.filter(_matches(text, pattern, possible if kind == "email" else possible & text.rlike("[0-9]")), lambda x: _valid(kind, x["m"]))
        return F.transform(valid, lambda x: F.struct(x["s"].alias("s"), F.lit(KINDS.index(kind)).alias("k"), F.lit(kind).alias("kind"), x["e"].alias("e"), F.lit(True).alias("base")))

    rows = rows.withColumn(fixed_, F.concat(*(fixed(kind, *how) for kind, how in BASE.items())))
    limit = F.create_map(*(F.lit(v) for k in KINDS for v in (k, model.thresholds[k])))
    accepted = F.filter(_candidates(text, F.col(chunks_)), lambda c: model.score(c["f"]) >= limit[c["kind"]])
    order = F.create_map(*(F.lit(v) for i, k in enumerate(KINDS) for v in (k, i)))
    rows = rows.withColumn(loose_, F.transform(accepted, lambda c: F.struct(c["s"].alias("s"), order[c["kind"]].alias("k"), c["kind"].alias("kind"), c["e"].alias("e"), F.lit(False).alias("base"))))
    # Fixed spans by start and candidates by end, in one order: those a candidate may overlap come before it.
    place = lambda x, key, turn: F.struct(key.alias("key"), F.lit(turn).alias("turn"), x.alias("x"))
    both = F.sort_array(F.concat(F.transform(fixed_, lambda b: place(b, b["s"], 1)), F.transform(loose_, lambda c: place(c, c["e"], 0))))
    none = F.array().cast(f"array<{_SPAN}>")
    clear = _scanned(both, F.lit(0), _SPAN, lambda end, y: (F.when(y["turn"] == 1, F.greatest(end, y["x"]["e"])).otherwise(end), F.when((y["turn"] == 0) & (end <= y["x"]["s"]), F.array(y["x"])).otherwise(none)))
    rows = rows.withColumn(free_, F.when(F.size(loose_) > 0, F.sort_array(clear)).otherwise(F.col(loose_)))
    taken = _scanned(F.col(free_), F.lit(0), _SPAN, lambda end, x: (F.when(x["s"] >= end, x["e"]).otherwise(end), F.when(x["s"] >= end, F.array(x)).otherwise(none)))
    spans = F.when(F.size(free_) > 0, F.concat(F.col(fixed_), taken)).otherwise(F.col(fixed_))
    return rows.withColumn(name, F.sort_array(spans)).select(*kept, name)


def pii_digest(docs: DataFrame) -> DataFrame:
    """Counts, digest and list of the spans of every document."""
    rows = find_spans(docs.select("doc_id", "text"), fit_spans(docs.sparkSession))
    spans = F.col("pii_spans")
    base = F.filter(spans, lambda x: x["base"])
    joined = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")
    number = lambda k: F.size(F.filter(base, lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = map(number, BASE)
    return rows.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(spans).alias("spans"))


def redact(docs: DataFrame, mask: str = "[{}]") -> DataFrame:
    """``docs``, same rows and columns, with every span replaced by its kind; n_chars follows where there is one.

    Of spans that overlap the one that starts first is replaced, and the rest of the others with it."""
    spans, chunks = unused(docs.columns, "pii_spans", "chunks_")
    rows = find_spans(docs, fit_spans(docs.sparkSession), spans).withColumn(chunks, _chunks(F.col("text")))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        gap = _between(F.col("text"), F.col(chunks), at, F.greatest(x["s"], at))
        tag = F.when(x["s"] >= at, F.format_string(mask.replace("{}", "%s"), F.upper(x["kind"]))).otherwise("")
        return F.greatest(at, x["e"]), F.array(F.concat(gap, tag))

    last = F.array_max(F.transform(spans, lambda x: x["e"]))
    done = F.concat(F.array_join(_scanned(F.col(spans), F.lit(0), "string", step), ""), F.substring(F.col("text"), last + 1, F.length("text")))
    text = F.when(F.size(spans) > 0, done).otherwise(F.col("text"))
    out = rows.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
