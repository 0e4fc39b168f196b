"""Secrets in texts: three patterns, and runs of characters with high entropy.

Only built-in expressions. Places of matches come from what ``split`` leaves
between them. A candidate is a run of 20 or more characters of the base-64
alphabets; a window of 20 characters slides over it. The counts of its characters
are kept as five-bit counters packed into seven numbers: each step takes one from
a counter and adds one to another, and the sum of c * log2(c), and the counts by
character class, change by what these two contribute. The entropy a window needs
depends on its class: hexadecimal digits, letters with digits, or letters of both
cases without them. Windows that have it are joined to spans; candidates on the
allow-list and spans inside a pattern's span are left out. A
span is a sample, and left out too, if each of its windows has a character of a
sample word or of a repetition that begins the candidate; one window clear of
them keeps the whole span.

Cases: a null or empty text has no spans; places are in code points, ends
exclusive; overlaps between kinds stay, except as said; repeated rows get equal
results; windows without two digits and two letters count only if they hold six
letters of either case; runs of any length are scanned whole; other columns keep
their names and values; an empty table gives no rows.
"""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlake.llm.common import set_aside

WINDOW = 20
#: Least entropy, in bits a character, of a window of hexadecimal digits, of letters and digits, and of letters.
HEX_BITS, MIXED_BITS, LETTER_BITS = 3.0, 3.6, 3.9
#: Letters of each case that a window without two digits must have.
EACH_CASE = 6
KINDS = ("assign", "access", "hex", "entropy")

# The patterns, and what a text must contain for the first.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
# Candidates that are known not to be secrets: UUIDs, and names or
# paths of plain words or numbers joined by signs. The second says what such a
# name cannot have: another character, a letter beside a digit, a sign other
# than a slash in front, or nothing but slashes.
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
NO_PLAIN_NAME = r"[^a-z0-9/_=-]|[a-z][0-9]|[0-9][a-z]|^/*[_=-]|^/*$"
# Fixed value: parts of candidates that are known not to be secrets, a repetition at the beginning and samples.
SAMPLE = r"^(.{1,4})\1{4,}|(?i:example|sample|dummy|placeholder|x{4,}|abcdefgh|012345678?|12345678)"


def _matches(text: Column, pattern: str, may: Column) -> Column:
    """array<struct<s, e, m>>: start, end and text of each match, where ``may`` holds."""
    parts = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    rows = F.when(may, F.arrays_zip(parts.alias("p"), found.alias("m")))
    return rows


def _placed(rows: Column) -> Column:
    """Starts and ends from the parts before each match; sums go by blocks of 256, so many matches stay cheap."""
    size = lambda x: F.length(x["p"]) + F.coalesce(F.length(x["m"]), F.lit(0))
    lengths = F.transform(rows, size)
    total = lambda values: F.aggregate(values, F.lit(0), lambda a, b: a + b)
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor(F.size(rows) / 256).cast("int")),
        lambda b: total(F.slice(lengths, b * 256 + 1, 256)),
    )
    sums = F.struct(lengths.alias("lengths"), blocks.alias("blocks"))
    starts = _let(
        sums,
        lambda known: F.transform(
            F.filter(F.transform(rows, lambda x, i: F.struct(i.alias("i"), x["p"].alias("p"), x["m"].alias("m"))),
                     lambda x: x["m"].isNotNull()),
            lambda x: F.struct(
                (total(F.slice(known["blocks"], 1, F.floor(x["i"] / 256).cast("int")))
                 + total(F.slice(known["lengths"], F.floor(x["i"] / 256).cast("int") * 256 + 1, x["i"] % 256))
                 + F.length(x["p"])).alias("s"),
                x["m"].alias("m"),
            ),
        ),
    )
    return F.transform(
        starts,
        lambda x: F.struct(x["s"].alias("s"), (x["s"] + F.length(x["m"])).alias("e"), x["m"].alias("m")),
    )


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _masked(candidate: Column) -> Column:
    """``candidate`` with a blank for each character of a sample."""
    parts = _matches(candidate, SAMPLE, candidate.rlike(SAMPLE))
    blank = lambda x: F.concat(x["p"], F.repeat(F.lit(" "), F.coalesce(F.length(x["m"]), F.lit(0))))
    return F.coalesce(F.array_join(F.transform(parts, blank), ""), candidate)


def _entropy_spans(candidate: Column) -> Column:
    """array<struct<s, e>> of the windows of one candidate that count, joined where they touch, if one is clear of samples."""
    # What the count of a character going from n - 1 to n adds to the sum.
    grow = F.array(F.lit(0.0), *[
        F.lit((c * log2(c)) - ((c - 1) * log2(c - 1) if c > 1 else 0.0)) for c in range(1, WINDOW + 2)
    ])
    # Character codes from "+" (43) to "z" (122): twelve counters of five bits to a number.
    code = lambda c: F.ascii(c) - 43
    described = lambda c, shown: F.struct(
        c.alias("c"),
        F.floor(code(c) / 12).cast("int").alias("at"),
        (5 * (code(c) % 12)).alias("bit"),
        F.call_function("shiftleft", F.lit(1).cast("long"), 5 * (code(c) % 12)).alias("unit"),
        (shown == " ").alias("sample"),
        c.between("0", "9").cast("int").alias("digit"),
        c.between("A", "Z").cast("int").alias("upper"),
        c.between("a", "z").cast("int").alias("lower"),
        (~(c.between("0", "9") | c.between("a", "f") | c.between("A", "F"))).cast("int").alias("other"),
    )
    classes = {"digits": "digit", "uppers": "upper", "lowers": "lower", "others": "other"}
    start = F.struct(
        F.lit(0.0).alias("sum"), F.array_repeat(F.lit(0).cast("long"), 7).alias("counts"),
        *[F.lit(0).alias(of) for of in classes],
        F.lit(-1).alias("sample"), F.lit(-1).alias("s"), F.lit(-1).alias("e"), F.lit(False).alias("clear"),
        F.array().cast("array<struct<s:int,e:int>>").alias("spans"),
    )
    gone = F.struct(
        F.lit(None).cast("string").alias("c"), F.lit(0).alias("at"), F.lit(0).alias("bit"), F.lit(0).cast("long").alias("unit"),
        F.lit(False).alias("sample"), *[F.lit(0).alias(name) for name in classes.values()],
    )

    def moved(state: Column, m: Column, i: Column) -> Column:
        """The state after one character came and, in a full window, one went."""
        held = lambda x: F.call_function(
            "shiftright", F.get(state["counts"], x["at"]), x["bit"]
        ).bitwiseAND(F.lit(31)).cast("int")
        n_out = F.when(m["out"]["c"].isNull(), F.lit(0)).otherwise(held(m["out"]))
        n_in = held(m["now"]) + 1 - F.coalesce(m["out"]["c"] == m["now"]["c"], F.lit(False)).cast("int")
        counts = F.transform(
            state["counts"],
            lambda x, k: x
            + F.when(m["now"]["at"] == k, m["now"]["unit"]).otherwise(F.lit(0))
            - F.when(m["out"]["at"] == k, m["out"]["unit"]).otherwise(F.lit(0)),
        )
        return F.struct(
            (state["sum"] - grow[n_out] + grow[n_in]).alias("sum"), counts.alias("counts"),
            *[(state[of] + m["now"][name] - m["out"][name]).alias(of) for of, name in classes.items()],
            F.when(m["now"]["sample"], i).otherwise(state["sample"]).alias("sample"),
        )

    def judged(state: Column, now: Column, i: Column) -> Column:
        bits = F.lit(log2(WINDOW)) - now["sum"] / WINDOW
        keyed = (now["digits"] >= 2) & (now["uppers"] + now["lowers"] >= 2)
        spelt = (now["uppers"] >= EACH_CASE) & (now["lowers"] >= EACH_CASE)
        least = (
            F.when(keyed & (now["others"] == 0), F.lit(HEX_BITS)).when(keyed, F.lit(MIXED_BITS)).when(spelt, F.lit(LETTER_BITS))
        )
        counts = (i >= WINDOW - 1) & F.coalesce(bits >= least, F.lit(False))
        return F.struct(
            counts.alias("counts"), (i - (WINDOW - 1)).alias("first"),
            (counts & (now["sample"] < i - (WINDOW - 1))).alias("clear"),
            ((state["e"] >= 0) & (i - (WINDOW - 1) <= state["e"])).alias("joins"),
        )

    def after(state: Column, now: Column, j: Column, i: Column) -> Column:
        begins = j["counts"] & ~j["joins"]
        closed = F.array(F.struct(state["s"].alias("s"), state["e"].alias("e")))
        return F.struct(
            now["sum"].alias("sum"), now["counts"].alias("counts"), *[now[of].alias(of) for of in classes],
            now["sample"].alias("sample"),
            F.when(begins, j["first"]).otherwise(state["s"]).alias("s"),
            F.when(j["counts"], i + 1).otherwise(state["e"]).alias("e"),
            F.when(begins, j["clear"]).otherwise(state["clear"] | j["clear"]).alias("clear"),
            F.when(begins & state["clear"], F.concat(state["spans"], closed)).otherwise(state["spans"]).alias("spans"),
        )

    def advance(chars: Column, state: Column, i: Column) -> Column:
        change = F.struct(
            F.get(chars, i).alias("now"),
            F.when(i >= WINDOW, F.get(chars, i - WINDOW)).otherwise(gone).alias("out"),
        )
        return _let(
            _let(change, lambda m: moved(state, m, i)),
            lambda now: _let(judged(state, now, i), lambda j: after(state, now, j, i)),
        )

    def finish(state: Column) -> Column:
        last = F.array(F.struct(state["s"].alias("s"), state["e"].alias("e")))
        return F.when(state["clear"], F.concat(state["spans"], last)).otherwise(state["spans"])

    return _let(
        F.zip_with(F.split(candidate, ""), F.split(_masked(candidate), ""), described),
        lambda chars: F.aggregate(
            F.sequence(F.lit(0), F.size(chars) - 1), start, lambda state, i: advance(chars, state, i), finish
        ),
    )


def _kind(spans: Column, number: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(number).alias("k"), x["e"].alias("e")))


def _kept(df: DataFrame, *new: Column) -> DataFrame:
    """The columns of ``df`` and new ones, computed once a row whatever reads them."""
    return df.select("*", F.inline(F.array(F.struct(*new))))


def with_spans(docs: DataFrame, column: str = "spans") -> DataFrame:
    """All columns of ``docs`` and array<struct<s, k, e>>: start, kind (place in KINDS) and end, in order."""
    at = docs.columns.index("text")
    rows, names = set_aside(docs)
    own = rows.columns
    rows = rows.withColumn("text", F.coalesce(F.col(f"_in{at}"), F.lit("")))
    lowered = F.lower("text")
    may = F.lit(False)
    for word in ASSIGN_WORDS:
        may = may | F.contains(lowered, F.lit(word))
    rows = _kept(
        rows,
        _matches(F.col("text"), ASSIGN, may).alias("assign"),
        _matches(F.col("text"), ACCESS, F.contains("text", F.lit("AKIA"))).alias("access"),
        _matches(F.col("text"), HEX, F.col("text").rlike(HEX)).alias("hex"),
        _matches(F.col("text"), CANDIDATE, F.col("text").rlike(r"[A-Za-z0-9+/_=-]{20}")).alias("runs"),
    ).select(*own, "assign", "access", "hex", "runs")
    rows = _kept(rows, *[
        F.when(F.col(name).isNotNull(), _placed(F.col(name))).alias(f"{name}_at")
        for name in ("assign", "access", "hex", "runs")
    ])
    none = F.array().cast("array<struct<s:int,k:int,e:int>>")
    value = lambda x: F.regexp_extract(x["m"], ASSIGN, 2)
    kinds = [
        F.filter("assign_at", lambda x: F.length(value(x)) >= 6),
        F.filter("access_at", lambda x: F.length(x["m"]) >= 20),
        F.filter("hex_at", lambda x: F.length(x["m"]) >= 24),
    ]
    allowed = lambda x: x["m"].rlike(UUID) | ~x["m"].rlike(NO_PLAIN_NAME)
    keyed = lambda x: x["m"].rlike("[0-9].*[0-9]") & x["m"].rlike("[A-Za-z].*[A-Za-z]")
    many = lambda x, of: F.length(F.translate(x["m"], of, "")) <= F.length(x["m"]) - EACH_CASE
    likely = F.filter("runs_at", lambda x: (keyed(x) | (many(x, UPPER) & many(x, LOWER))) & ~allowed(x))
    entropy = F.flatten(F.transform(
        likely,
        lambda x: F.transform(
            _entropy_spans(x["m"]),
            lambda y: F.struct((x["s"] + y["s"]).alias("s"), (x["s"] + y["e"]).alias("e")),
        ),
    ))
    rows = _kept(
        rows,
        F.concat(*[F.coalesce(_kind(found, i), none) for i, found in enumerate(kinds)]).alias("base"),
        F.coalesce(_kind(entropy, 3), none).alias("added"),
    )
    inside = lambda x: F.exists("base", lambda b: (b["s"] <= x["s"]) & (x["e"] <= b["e"]))
    spans = F.array_sort(F.concat("base", F.filter("added", lambda x: ~inside(x))))
    return rows.select(*names, spans.alias(column))


def _text_of(spans: Column) -> Column:
    kinds = F.array(*[F.lit(kind) for kind in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", kinds[x["k"]], x["s"], x["e"])), ",")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, their digest, and all spans as text."""
    found = with_spans(docs.select("doc_id", "text"), "spans").select("doc_id", "spans")
    count = lambda k: F.size(F.filter("spans", lambda x: x["k"] == k)).cast("long")
    base = F.filter("spans", lambda x: x["k"] < 3)
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_text_of(base).cast("binary"), 256).alias("base_sha256"),
        _text_of(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span, overlaps joined, replaced by ``mark``; other texts stay as they are."""
    names = docs.columns
    rows, back = set_aside(docs)
    found = with_spans(rows.withColumn("text", F.col(f"_in{names.index('text')}")), "spans")
    merged = F.aggregate(
        "spans",
        F.array().cast("array<struct<s:int,e:int>>"),
        lambda held, x: F.when(
            (F.size(held) > 0) & (x["s"] <= F.element_at(held, -1)["e"]),
            F.concat(
                F.slice(held, 1, F.size(held) - 1),
                F.array(F.struct(
                    F.element_at(held, -1)["s"].alias("s"),
                    F.greatest(F.element_at(held, -1)["e"], x["e"]).alias("e"),
                )),
            ),
        ).otherwise(F.concat(held, F.array(F.struct(x["s"].alias("s"), x["e"].alias("e"))))),
    )
    found = _kept(found, merged.alias("cuts"))
    ends = lambda i: F.when(i > 0, F.get("cuts", i - 1)["e"]).otherwise(0)
    kept = F.transform(
        F.sequence(F.lit(0), F.size("cuts")),
        lambda i: F.substring(
            F.col("text"),
            ends(i) + 1,
            F.when(i < F.size("cuts"), F.get("cuts", i)["s"]).otherwise(F.length("text")) - ends(i),
        ),
    )
    found = _kept(found, F.when(F.size("cuts") > 0, F.array_join(kept, mark)).alias("clean"))
    renewed = {
        "text": F.coalesce("clean", F.col(f"_in{names.index('text')}")).alias("text"),
        "n_chars": F.coalesce(F.length("clean").cast("long"), back[names.index("n_chars")]).alias("n_chars")
        if "n_chars" in names else None,
    }
    return found.select(*[renewed.get(name, column) for name, column in zip(names, back)])
