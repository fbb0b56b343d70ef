"""Secret scan: fixed patterns plus a randomness test battery. Native DataFrame operations only.

Pattern kinds (leftmost, non-overlapping): ``assign``, ``access`` and ``hex``. The battery adds kind
``random``: runs of at least 20 encoding characters in what the pattern spans leave of a text. Each
run's encoding is inferred (hex, base32, lower-case base36, base64; plain digits are no secrets). Its
statistics are counts of characters and of neighbours, so a run of megabytes costs no arrays:

* chi-squared of the alphabet's counts, by the coincidences ``C = sum c(c-1)/2`` that it rises with;
* runs: how often the character class (upper, lower, digit, sign) changes;
* serial correlation at lag one of the alphabet's quarters.

Each of them must be in keeping with even random text (two-sided for runs and serial, upper tail for
chi-squared, none under ``reject``), which ordinary wording and counting-up strings fail. The evidence
against ordinary wording is combined from two of them by Fisher's method: the chance of so few
coincidences among letters as uneven as ``WORDING`` says (normal tail with the exact moments), and the
chance of so many changes of class at its rate (Chernoff's bound on the binomial tail, which holds for
every length).

Benjamini-Hochberg control at ``fdr`` runs within each (encoding, length class), so that many short
runs cannot hide or excuse long ones. It works on counts by tenths of -log10 p, a table whose size is
bounded by encodings x classes x bins; the bin's upper edge stands for its members, which errs to the
careful side.

Positions are running sums of the lengths of matches and of what lies between, in three levels of
blocks, so the work grows in proportion to a text's matches.

Cases: a null or empty text has no spans; rows are never merged, so repeated ids give repeated rows;
an empty table gives an empty result; other columns are ignored. Offsets are code points from 0, ends
exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landweave.storage import materialize

#: Pattern, and the least length of the match or of its second group.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
#: A maximal run is the leftmost match, so a least length in the pattern finds the same runs.
HEX = r"[0-9a-f]{24,}"
RUN = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "random")

B64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
#: Alphabets by encoding, in the encoding's own order.
ALPHABETS = {"hex": "0123456789abcdef", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base36": "0123456789abcdefghijklmnopqrstuvwxyz", "base64": B64}

#: What ordinary wording and identifiers are taken to be, by encoding: sums of the squares and of the cubes of letter frequencies, and the rate at which the character class changes.
WORDING = {"hex": (0.125, 0.0157, 0.1), "base32": (0.065, 0.0054, 0.05), "base36": (0.065, 0.0054, 0.05), "base64": (0.05, 0.0035, 0.2)}

SPAN = "array<struct<s:int,e:int,t:string>>"
BLOCK = 32


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running_sums(values: Column, levels: int = 2) -> Column:
    """Sums of the values up to each place, itself included. A level adds the sums of blocks of ``BLOCK`` values."""
    total = lambda part: F.aggregate(part, F.lit(0), lambda s, x: s + x)

    def sums(a: Column) -> Column:
        if levels == 0:
            return F.transform(a, lambda x, i: total(F.slice(a, 1, i + 1)))
        blocks = F.transform(F.sequence(F.lit(0), (F.size(a) - 1).bitwiseAND(-BLOCK), F.lit(BLOCK)), lambda at: total(F.slice(a, at + 1, BLOCK)))
        inside = lambda i: total(F.slice(a, i - i % BLOCK + 1, i % BLOCK + 1))
        return _let(running_sums(blocks, levels - 1), lambda tops: F.transform(a, lambda x, i: F.coalesce(F.get(tops, F.floor(i / BLOCK).cast("int") - 1), F.lit(0)) + inside(i)))

    return _let(values, lambda a: F.when(F.size(a) > 0, sums(a)).otherwise(F.array().cast("array<int>")))


def _parts(text: Column, pattern: str) -> Column:
    """Arrays ``m`` of matches and ``g`` of what lies between."""
    return F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g"))


def _spans(text: Column, pattern: str, keep) -> Column:
    """Spans of the matches that ``keep`` accepts."""

    def spans(parts: Column) -> Column:
        # The ends of what precedes each match, and of the match: two sums a match.
        step = F.zip_with(parts["m"], F.slice(parts["g"], 1, F.size(parts["m"])), lambda m, g: F.char_length(g) + F.char_length(m))
        ends = running_sums(step)
        made = F.zip_with(parts["m"], ends, lambda m, e: F.struct((e - F.char_length(m)).alias("s"), e.alias("e"), m.alias("t")))
        return F.filter(made, lambda x: keep(x["t"]))

    return F.when(text.rlike(pattern), _let(_parts(text, pattern), spans)).otherwise(F.array().cast(SPAN))


def _blanked(text: Column, pattern: str, keep) -> Column:
    """``text`` with line ends in place of the characters of kept matches."""

    def blank(parts: Column) -> Column:
        hidden = F.transform(parts["m"], lambda m: F.when(keep(m), F.repeat(F.lit("\n"), F.char_length(m))).otherwise(m))
        return F.array_join(F.zip_with(parts["g"], hidden, lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")

    return F.when(text.rlike(pattern), _let(_parts(text, pattern), blank)).otherwise(text)


#: Pattern and test of each base kind, in the order of ``KINDS``.
BASE = {
    "assign": (ASSIGN, lambda m: F.char_length(F.regexp_extract(m, ASSIGN, 2)) >= 6),
    "access": (ACCESS, lambda m: F.char_length(m) >= 20),
    "hex": (HEX, lambda m: F.lit(True)),
}


def pattern_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and span arrays ``assign``, ``access``, ``hex``, and ``runs`` of what those leave, of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    left = F.col("text")
    for pattern, keep in BASE.values():
        left = _blanked(left, pattern, keep)
    # Texts without a long run need no blanking.
    runs = F.when(F.col("text").rlike(RUN), _let(left, lambda rest: _spans(rest, RUN, lambda m: F.lit(True)))).otherwise(F.array().cast(SPAN))
    return docs.select("doc_id", *[_spans(F.col("text"), *of).alias(k) for k, of in BASE.items()], runs.alias("runs"))


def _upper_tail(z: Column) -> Column:
    """P(Z > z) for z >= 0, by the usual five-term polynomial times the density."""
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.2316419) * z)
    poly = F.lit(0.0)
    for b in (1.330274429, -1.821255978, 1.781477937, -0.356563782, 0.319381530):
        poly = (poly + F.lit(b)) * t
    return F.exp(-z * z / 2) / F.lit(2.5066282746310002) * poly


def _two_sided(z: Column) -> Column:
    return F.least(F.lit(1.0), 2 * _upper_tail(F.abs(z)))


def _classes(alphabet: str) -> tuple[float, float]:
    """Sums of the squares and of the cubes of the shares of the character classes in an alphabet."""
    counts = [sum(map(test, alphabet)) for test in (str.isupper, str.islower, str.isdigit)]
    shares = [c / len(alphabet) for c in (*counts, len(alphabet) - sum(counts))]
    return sum(x**2 for x in shares), sum(x**3 for x in shares)


def _by_encoding(value) -> Column:
    return F.create_map(*[x for k in ALPHABETS for x in (F.lit(k), F.lit(value(k)))])[F.col("encoding")]


def _level(encoding: str) -> Column:
    """The run with each character's quarter of the alphabet in its place."""
    abc = ALPHABETS[encoding]
    return F.translate("__t", abc, "".join(str(4 * i // len(abc)) for i in range(len(abc))))


def battery(runs: DataFrame, token: str = "t") -> DataFrame:
    """``runs`` with ``encoding``, ``n``, the statistics, their p-values for even random text (``p_chi``, ``p_runs``,
    ``p_serial``), and ``p_even`` and ``p_change`` for ordinary wording, with ``p_wording`` from both; plain digits go."""
    raw = F.regexp_replace(F.col(token), "=+$", "")
    kind = (
        F.when(raw.rlike("^[0-9]*$"), F.lit(None))
        .when(raw.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex")
        .when(raw.rlike("^[A-Z2-7]+$"), "base32")
        .when(raw.rlike("^[0-9a-z]+$"), "base36")
        .otherwise("base64")
    )
    df = runs.withColumn("encoding", kind).where("encoding is not null")
    df = df.withColumn("__t", F.when(F.col("encoding") == "hex", F.lower(raw)).otherwise(F.translate(raw, "-_=", "+/+")))
    n, size = F.col("n").cast("double"), _by_encoding(lambda k: float(len(ALPHABETS[k])))
    df = df.withColumns({"n": F.char_length("__t"), "__abc": _by_encoding(lambda k: ALPHABETS[k])})
    # Characters outside the alphabet do not occur, so taking one out counts it.
    counts = F.transform(F.split("__abc", ""), lambda c: F.when(c == "", 0.0).otherwise(F.col("n") - F.char_length(F.replace(F.col("__t"), c, F.lit("")))).cast("double"))
    level = F.coalesce(*[F.when(F.col("encoding") == k, _level(k)) for k in ALPHABETS])
    df = df.withColumns({"coincidences": F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * (c - 1) / 2), "__l": level})
    df = df.withColumn("changes", F.regexp_count("__t", F.lit("[A-Z]+|[a-z]+|[0-9]+|[^A-Za-z0-9]+")) - 1)
    of = [F.col("n") - F.char_length(F.replace(F.col("__l"), F.lit(str(k)), F.lit(""))) for k in range(4)]
    ends = [F.substring("__l", i, 1).cast("double") for i in (1, -1)]
    total, squares = (sum((of[k] * k**e for k in range(1, 4)), F.lit(0.0)) for e in (1, 2))
    products = sum((F.regexp_count("__l", F.lit(f"{a}(?={b})")) * (a * b) for a in range(1, 4) for b in range(1, 4)), F.lit(0.0))
    df = df.withColumns({"__s": total, "__ss": squares, "__p": products, "__first": ends[0], "__last": ends[1]})
    mean = F.col("__s") / n
    cov = F.col("__p") - mean * (2 * F.col("__s") - F.col("__first") - F.col("__last")) + (n - 1) * mean * mean
    var = F.col("__ss") - n * mean * mean
    pairs, m = n * (n - 1) / 2, n - 1
    s2, s3 = _by_encoding(lambda k: WORDING[k][0]), _by_encoding(lambda k: WORDING[k][1])
    z_low = (pairs * s2 - F.col("coincidences")) / F.sqrt(pairs * (s2 - s2 * s2 + 2 * (n - 2) * (s3 - s2 * s2)))
    z_high = (F.col("coincidences") - pairs / size) / F.sqrt(pairs / size * (1 - 1 / size))
    c2, c3 = _by_encoding(lambda k: _classes(ALPHABETS[k])[0]), _by_encoding(lambda k: _classes(ALPHABETS[k])[1])
    z_runs = (F.col("changes") - m * (1 - c2)) / F.sqrt(m * (1 - c2) * c2 + 2 * (m - 1) * (c3 - c2 * c2))
    x, r = F.least(F.col("changes") / m, F.lit(1.0)), _by_encoding(lambda k: WORDING[k][2])
    far = x * F.log(x / r) + F.when(x < 1, (1 - x) * F.log((1 - x) / (1 - r))).otherwise(0.0)
    fisher = F.col("p_even") * F.col("p_change")
    return (
        df.withColumns(
            {
                "chi_squared": size / n * (2 * F.col("coincidences") + n) - n,
                "serial": F.when(var > 0, cov / var).otherwise(1.0),
                "p_chi": F.when(z_high > 0, _upper_tail(z_high)).otherwise(1.0),
                "p_runs": _two_sided(z_runs),
                "p_even": F.when(z_low > 0, _upper_tail(z_low)).otherwise(1.0),
                "p_change": F.when(x > r, F.exp(-m * far)).otherwise(1.0),
            }
        )
        # Neighbours of a random string correlate by -1/n.
        .withColumns({"p_serial": _two_sided((F.col("serial") + 1 / n) * F.sqrt(n)), "p_wording": F.when(fisher > 0, fisher * (1 - F.log(fisher))).otherwise(0.0)})
        .drop("__t", "__abc", "__l", "__s", "__ss", "__p", "__first", "__last")
    )


def discoveries(tested: DataFrame, fdr: float = 0.01, reject: float = 0.001) -> DataFrame:
    """Rows of :func:`battery` that stand as random under the false-discovery rate, by (encoding, length class)."""
    even = (F.col("p_chi") >= reject) & (F.col("p_runs") >= reject) & (F.col("p_serial") >= reject)
    p = F.when(even, F.col("p_wording")).otherwise(1.0)
    tested = tested.withColumns({"p": p, "length_class": F.floor(F.log2("n")).cast("int"), "bin": F.least(F.floor(-F.log10(F.greatest(p, F.lit(1e-40))) * 10), F.lit(400)).cast("int")})
    counts = tested.groupBy("encoding", "length_class", "bin").agg(F.count(F.lit(1)).alias("k"))
    of = Window.partitionBy("encoding", "length_class")
    above = F.sum("k").over(of.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    edge = F.pow(F.lit(10.0), -F.col("bin") / 10)
    cuts = counts.withColumn("ok", edge <= above * fdr / F.sum("k").over(of)).where("ok").groupBy("encoding", "length_class").agg(F.min("bin").alias("cut"))
    # At most encodings x length classes rows, whatever the input.
    return tested.join(F.broadcast(cuts), ["encoding", "length_class"]).where(F.col("bin") >= F.col("cut")).drop("cut")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = 0.01, reject: float = 0.001) -> DataFrame:
    """``doc_id`` and one array of (s, k, e), k the kind's number, with all spans by start, for every row of ``docs``."""
    found = materialize(pattern_spans(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    number = lambda name, k: F.transform(name, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e")))
    base = F.concat(*[number(name, k) for k, name in enumerate(BASE)])
    found = found.select("row", "doc_id", "runs", F.array_sort(base).alias("base"))
    tested = battery(found.where(F.size("runs") > 0).select("row", F.inline("runs")))
    new = discoveries(tested, fdr, reject).groupBy("row").agg(F.collect_list(F.struct(F.col("s"), F.lit(3).alias("k"), F.col("e"))).alias("new"))
    joined = found.select("row", "doc_id", "base").join(new, "row", "left")
    every = F.array_sort(F.concat("base", F.coalesce("new", F.array().cast("array<struct<s:int,k:int,e:int>>"))))
    return joined.select("doc_id", "base", every.alias("spans"))


def _text(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    count = lambda k: F.size(F.filter("spans", lambda x: x["k"] == k)).cast("long")
    return scan(docs.select("doc_id", "text")).select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)], F.sha2(_text("base"), 256).alias("base_sha256"), _text("spans").alias("spans"))
