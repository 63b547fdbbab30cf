"""Secret scan: fixed patterns plus a randomness test battery, all in built-in functions.

Fixed kinds are matched leftmost and non-overlapping over the whole text; matches whose
length fails are dropped afterwards, as they use up their characters. Positions come from
splitting the text at the matches: the lengths of the pieces between them and of the
matches are summed along the text, in one ordered pass over its matches.

The battery looks at every long run of key characters outside the fixed kinds. Its
encoding is inferred from its characters (hexadecimal, base 32, base 64), and as a random
string in that alphabet it has to stand three tests:

* chi-squared: each character class of the alphabet has its uniform share, and as many
  different characters occur as in a uniform string;
* runs: the classes change as often as in a uniform string;
* serial correlation: the place of a character in the alphabet says nothing of the next.

The three p-values give one per candidate by Fisher's sum. False discovery control runs the other way round: word-like strings are what a
candidate must be told apart from. Within each length class, the Benjamini-Hochberg
line over a fixed grid of p-values finds the candidates that are not random at rate
``FDR``; they go. Candidates too short for the battery to reject anything are not
candidates. Class counts and grid counts are bounded, so their tables are broadcast.

Results: one row per input row. Null and empty texts have no spans. Repeated rows are
counted as often as they occur. An empty table gives an empty result.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evlens.llm.common import stored

# Patterns, group that is measured, least length of it; in the order of kinds.
KINDS = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""",
     r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", 6),
    ("access", r"AKIA[A-Z0-9]+", "", 20),
    ("hex", r"[0-9a-f]{24,}", "", 24),
)
CANDIDATE = r"[A-Za-z0-9+/_-]{24,}={0,2}"     # long runs of key characters
FDR = 0.05
BLOCK = 512                                   # code points that a text is cut into to be put together anew
GRID = 128                                    # steps of the p-value grid, evenly spaced in -log p
GRID_STEP = 0.25
LENGTH_CLASSES = (32, 48, 64, 128, 256)       # upper bounds of the length classes; longer ones form a last class
# Encodings by the characters they may use; alphabet size.
ENCODINGS = (("hex", r"^([0-9a-f]+|[0-9A-F]+)$", 16), ("base32", r"^[A-Z2-7]+=*$", 32), ("base64", r"^[A-Za-z0-9+/_-]+=*$", 64))


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def _matches(text: Column, kind: int, pattern: str) -> Column:
    """array<struct<kind, at, gap, word>>: leftmost non-overlapping matches in order, and the code points before each."""
    pieces = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1),
                        lambda w, g: F.struct(F.char_length(g).alias("gap"), w.alias("word")))
    real = F.filter(pieces, lambda x: x["word"].isNotNull())
    numbered = F.transform(real, lambda x, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("at"), x["gap"].alias("gap"), x["word"].alias("word")))
    return F.when(text.rlike(pattern), numbered).otherwise(F.array().cast("array<struct<kind:int,at:int,gap:int,word:string>>"))


def _normal_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal, by the logistic approximation of its distribution function."""
    return 1 / (1 + F.exp(F.least(F.greatest(1.5976 * z + 0.070566 * z * z * z, F.lit(-700.0)), F.lit(700.0))))


def _chi_tail(x: Column, df: Column) -> Column:
    """P(chi-squared > x), by the cube-root normal approximation."""
    v = F.lit(2.0) / (F.lit(9.0) * df)
    return _normal_tail((F.pow(F.greatest(x, F.lit(0.0)) / df, F.lit(1.0 / 3)) - (1 - v)) / F.sqrt(v))


def battery(candidates: DataFrame) -> DataFrame:
    """``candidates`` (with ``word``) with encoding, the three test scores and ``p`` of being random."""
    body = F.regexp_replace("word", "=+$", "")
    encoding = F.coalesce(*[F.when(F.col("word").rlike(p), F.lit(n)) for n, p, _ in ENCODINGS])
    rows = candidates.withColumn("encoding", encoding).where("encoding is not null").withColumn("body", body)
    size = F.coalesce(*[F.when(F.col("encoding") == n, F.lit(float(k))) for n, _, k in ENCODINGS])
    # Classes: lower case, upper case, digits, rest; with their share of the inferred alphabet.
    shares = {"hex": (6, 0, 10, 0), "base32": (0, 26, 6, 0), "base64": (26, 26, 10, 2)}
    upper_hex = (F.col("encoding") == "hex") & F.col("body").rlike("[A-F]")
    folded = F.when(upper_hex, F.lower("body")).otherwise(F.col("body"))
    rows = rows.select("*", size.alias("size"), F.char_length("body").cast("double").alias("n"), folded.alias("plain"))
    kinds = ("[^a-z]", "[^A-Z]", "[^0-9]", "[A-Za-z0-9]")
    counts = [F.char_length(F.regexp_replace("plain", k, "")).cast("double") for k in kinds]
    chi, deg, same = F.lit(0.0), F.lit(-1.0), F.lit(0.0)
    for i in range(4):
        share = F.coalesce(*[F.when(F.col("encoding") == e, F.lit(float(s[i]))) for e, s in shares.items()]) / F.col("size")
        want = share * F.col("n")
        chi = chi + F.when(share > 0, (counts[i] - want) * (counts[i] - want) / F.greatest(want, F.lit(1e-9))).otherwise(0.0)
        deg = deg + F.when(share > 0, 1.0).otherwise(0.0)
        same = same + share * share
    # How many different characters a uniform string of this length has, with its spread: repeated letters show here.
    letters = F.split("plain", "")
    kept = F.filter(letters, lambda c: c != "")
    distinct = F.size(F.array_distinct(kept)).cast("double")
    q = F.pow(1 - 1 / F.col("size"), F.col("n"))
    q2 = F.pow(1 - 2 / F.col("size"), F.col("n"))
    mean = F.col("size") * (1 - q)
    var = F.col("size") * (F.col("size") - 1) * q2 + F.col("size") * q - F.col("size") * F.col("size") * q * q
    repeats = (distinct - mean) / F.sqrt(F.greatest(var, F.lit(1e-6)))
    chi, deg = chi + repeats * repeats, deg + 1
    # Runs: places where neighbours are of different classes.
    klass = F.translate(F.translate(F.translate("plain", "abcdefghijklmnopqrstuvwxyz", "a" * 26),
                                    "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "B" * 26), "0123456789", "1" * 10)
    runs = F.char_length(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(
        klass, r"a+", "a"), r"B+", "B"), r"1+", "1"), r"[^aB1]+", "."))
    expected = 1 + (F.col("n") - 1) * (1 - same)
    run_score = (runs - expected) / F.sqrt(F.greatest((F.col("n") - 1) * same * (1 - same), F.lit(1e-6)))
    # Serial correlation at lag one of the characters' code values.
    codes = F.transform(kept, lambda c: F.ascii(c).cast("double"))
    rows = rows.select("*", chi.alias("chi"), deg.alias("deg"), run_score.alias("runs"), codes.alias("codes"))
    avg = F.aggregate("codes", F.lit(0.0), lambda a, x: a + x) / F.col("n")
    rows = rows.withColumn("avg", avg)
    square = F.aggregate("codes", F.lit(0.0), lambda a, x: a + (x - F.col("avg")) * (x - F.col("avg")))
    pairs = F.zip_with(F.slice("codes", F.lit(1), F.size("codes") - 1), F.slice("codes", F.lit(2), F.size("codes") - 1),
                       lambda x, y: (x - F.col("avg")) * (y - F.col("avg")))
    cross = F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x)
    serial = F.sqrt("n") * cross / F.greatest(square, F.lit(1e-9))
    rows = rows.withColumn("serial", serial)
    tails = [_chi_tail(F.col("chi"), F.col("deg")),
             2 * _normal_tail(F.abs("runs")), 2 * _normal_tail(F.abs("serial"))]
    fisher = F.lit(0.0)
    for t in tails:
        fisher = fisher - 2 * F.log(F.greatest(F.least(t, F.lit(1.0)), F.lit(1e-300)))
    return rows.withColumn("p", _chi_tail(fisher, F.lit(6.0))).drop("codes", "avg", "plain", "body")


def non_random(tested: DataFrame, rate: float = FDR) -> DataFrame:
    """Per length class, the largest p-value up to which "not random" is declared at this false discovery rate.

    p-values are counted on a fixed grid of -log p, so the ranking needs bounded counts, not a sort of all candidates.
    """
    cell = F.least(F.floor(-F.log(F.greatest(F.col("p"), F.lit(1e-300))) / GRID_STEP), F.lit(GRID - 1)).cast("int")
    counts = (tested.select("length_class", cell.alias("cell")).groupBy("length_class", "cell")
              .agg(F.count(F.lit(1)).alias("k")).groupBy("length_class")
              .agg(F.collect_list(F.struct("cell", "k")).alias("cells"), F.sum("k").alias("m")))
    # In cell c lie p-values up to exp(-c * step); rejecting all from c on is allowed if that bound is at most rate * rank / m.
    line = F.filter(F.sequence(F.lit(0), F.lit(GRID - 1)), lambda c: F.exp(-c * GRID_STEP) * F.col("m") <= rate * F.aggregate(
        F.filter("cells", lambda x: x["cell"] >= c), F.lit(0).cast("long"), lambda a, x: a + x["k"]))
    return counts.select("length_class", F.coalesce(F.array_min(line), F.lit(GRID)).alias("cut"))


def _placed(found: DataFrame) -> DataFrame:
    """``(row, kind, start, stop, word)`` of the fixed kinds' spans, and of candidates that touch none of them.

    Places are running sums over a text's matches of one kind, and a candidate touches a
    fixed span if the running maximum of the stops of those that begin before its own stop
    is past its start: both take one ordered pass over the matches of a text, however many.
    """
    size = F.char_length("word")
    each = found.where(F.size("hits") > 0).select("row", F.inline("hits"))
    stop = F.sum(F.col("gap") + size).over(Window.partitionBy("row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    least = F.lit(True)
    for kind, (_, _, head, n) in enumerate(KINDS):
        measured = F.char_length(F.regexp_replace("word", head, "")) if head else size
        least = least & ((F.col("kind") != kind) | (measured >= n))
    placed = (each.select("row", "kind", (stop - size).cast("int").alias("start"), stop.cast("int").alias("stop"), "word")
              .where(least))
    fixed = F.col("kind") < len(KINDS)
    before = Window.partitionBy("row").orderBy(F.when(fixed, F.col("start")).otherwise(F.col("stop")), fixed).rowsBetween(
        Window.unboundedPreceding, 0)
    touched = F.max(F.when(fixed, F.col("stop"))).over(before)
    return (placed.withColumn("touched", touched).where(fixed | F.col("touched").isNull() | (F.col("touched") <= F.col("start")))
            .select("row", "kind", "start", "stop", F.when(~fixed, F.col("word")).alias("word")))


def _found(plain: DataFrame, keep: str, rate: float) -> tuple[DataFrame, DataFrame]:
    """A number and the column ``keep`` of every row of ``plain``, and the spans ``(row, kind, start, stop)`` in its ``text``."""
    patterns = [*(k[1] for k in KINDS), CANDIDATE]
    rows = stored(plain.select(F.monotonically_increasing_id().alias("row"), keep, F.concat(
        *[_matches(F.col("text"), kind, p) for kind, p in enumerate(patterns)]).alias("hits")), "secrets")
    spans = stored(_placed(rows), "spans")
    bounds = F.array(*[F.lit(b) for b in LENGTH_CLASSES])
    tested = stored(battery(spans.where(F.col("kind") == len(KINDS)))
                    .withColumn("length_class", F.size(F.filter(bounds, lambda b: b < F.col("n"))))
                    .select("row", "kind", "start", "stop", "p", "length_class"), "tested")
    cell = F.least(F.floor(-F.log(F.greatest(F.col("p"), F.lit(1e-300))) / GRID_STEP), F.lit(GRID - 1)).cast("int")
    # One row per length class: a proven bound for the broadcast.
    random = tested.join(F.broadcast(non_random(tested, rate)), "length_class").where(cell < F.col("cut"))
    columns = ["row", "kind", "start", "stop"]
    return rows.drop("hits"), spans.where(F.col("kind") < len(KINDS)).select(columns).unionByName(random.select(columns))


def scan(docs: DataFrame, rate: float = FDR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``base``, array<struct<start, kind, stop>> of the fixed kinds, and ``spans`` of all kinds, in order.

    The battery's kind is len(KINDS).
    """
    rows, spans = _found(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), _text(text_col).alias("text")), "doc_id", rate)
    by_row = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "stop"))).alias("spans"))
    none = F.array().cast("array<struct<start:int,kind:int,stop:int>>")
    return (rows.select("row", "doc_id").join(by_row, "row", "left")
            .select("doc_id", F.coalesce("spans", none).alias("spans"))
            .select("doc_id", F.filter("spans", lambda s: s["kind"] < len(KINDS)).alias("base"), "spans"))


def _joined(spans: str) -> Column:
    names = F.array(*[F.lit(k[0]) for k in KINDS], F.lit("random"))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def summary(docs: DataFrame, rate: float = FDR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts per fixed kind, digest of the fixed spans, and all spans as text."""
    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return scan(docs, rate, id_col, text_col).select(
        "doc_id", *[count(k).alias(f"n_{name}") for k, (name, *_) in enumerate(KINDS)], F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))


def redact(docs: DataFrame, rate: float = FDR, mark: str = "[SECRET]", text_col: str = "text") -> DataFrame:
    """``docs`` with every span of every kind replaced by ``mark``, and ``n_chars`` to match.

    Texts without any match of any pattern go through untouched; only the others are joined
    with their new texts, by a hash of the text and the text itself. A text is put together
    from the pieces between its spans, taken from blocks of ``BLOCK`` code points, so the
    work grows with the text, not with text times spans.
    """
    text = F.col(f"`{text_col}`")
    any_kind = "|".join(f"({p})" for p in [*[k[1] for k in KINDS], CANDIDATE])
    touched = F.coalesce(text.rlike(any_kind), F.lit(False))
    hits = docs.where(touched)
    rows, spans = _found(hits.select(text.alias("text")).distinct(), "text", rate)
    earlier = F.max("stop").over(Window.partitionBy("row").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1))
    begun = (spans.withColumn("since", F.coalesce(earlier, F.lit(0))).groupBy("row").agg(
        # Overlapping spans are replaced together: only the first of them begins a mark.
        F.array_sort(F.collect_list(F.when(F.col("start") >= F.col("since"), F.struct("start", "since")))).alias("cuts"),
        F.max("stop").alias("last")))

    def piece(a: Column, b: Column) -> Column:
        first = F.floor(a / BLOCK).cast("int")
        near = F.array_join(F.slice("blocks", first + 1, F.greatest(F.ceil(b / BLOCK).cast("int") - first, F.lit(0))), "")
        return F.substring(near, a - first * BLOCK + 1, b - a)

    blocks = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    new = (rows.join(begun, "row").select("text", "cuts", "last", blocks.alias("blocks"), F.char_length("text").alias("size"))
           .select(F.xxhash64("text").alias("new_key"), F.col("text").alias("old_text"), F.concat(
               F.array_join(F.transform("cuts", lambda c: F.concat(piece(c["since"], c["start"]), F.lit(mark))), ""),
               piece(F.col("last"), F.col("size"))).alias("new_text")))
    joined = hits.join(new, (F.xxhash64(text) == F.col("new_key")) & (text == F.col("old_text")), "left")
    changed = F.col("new_text").isNotNull()
    done = joined.select(*[
        (F.coalesce(F.col("new_text"), text) if c == text_col else
         F.when(changed, F.char_length("new_text").cast("long")).otherwise(F.col("n_chars")) if c == "n_chars"
         else F.col(f"`{c}`")).alias(c) for c in docs.columns])
    return done.unionByName(docs.where(~touched))
