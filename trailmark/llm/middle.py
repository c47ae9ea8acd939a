"""Fill-in-the-middle: texts cut at unit boundaries into prefix, middle and suffix, and put together anew.

A unit grammar is told by its classes alone: neighbouring characters of one run class belong together, all others part.  It
becomes a regex without width that looks at both neighbours, and ``split`` by that keeps every piece as it is.  A text is split
in blocks, one at a time, so that a long one needs no more memory than a short one; a block that goes on with the unit
of the one before counts one less.  There is no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import doc_rows, public_id

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Run classes of some grammars: letters and single other characters, single characters, words and the space between them.
LETTERS: tuple[str, ...] = ("A-Za-z",)
CHARACTERS: tuple[str, ...] = ()
WORDS: tuple[str, ...] = (r"\x20\x09-\x0D", r"^\x20\x09-\x0D")
#: Code points of a block.
BLOCK = 512


def boundary(runs: Sequence[str]) -> str:
    """Where a unit ends and another begins: before a character of no run class, and before one of a class that its left
    neighbour isn't of.  ``split`` ignores a match before the first character, and none is behind the last."""
    whole = r"(?<=[\s\S])"  # not within a character of two code units
    single = "".join(f"(?![{c}])" for c in runs) + r"(?=[\s\S])"
    return "|".join(x + whole for x in (single, *(f"(?=[{c}])(?<![{c}])" for c in runs)))


def units(text: Column, runs: Sequence[str]) -> Column:
    """The units of a text, in order; an empty one, which ``split`` would give as a piece, has none."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, boundary(runs), -1))


def _goes_on(left: Column, right: Column, runs: Sequence[str]) -> Column:
    """0 or 1: whether right's first character belongs to the unit of left's last one."""
    both = F.concat(F.right(left, F.lit(1)), F.substring(right, 1, 1))
    return (F.char_length(both) - F.size(F.split(both, boundary(runs), -1))).cast("int")


def _blocks(parts: Column, runs: Sequence[str]) -> Column:
    """array<struct<text, joined, units>>: of each block whether it goes on with a unit (0 or 1) and how many pieces it has."""

    def seen(part: Column, i: Column) -> Column:
        joined = F.when(i > 0, _goes_on(F.get(parts, i - 1), part, runs)).otherwise(F.lit(0))
        return F.struct(part.alias("text"), joined.alias("joined"), F.size(units(part, runs)).alias("units"))

    return F.transform(parts, seen)


def _place(blocks: Column, unit: Column, runs: Sequence[str]) -> Column:
    """How many code points stand before unit number ``unit`` (from 0); of the number of all units, how many there are."""
    zero = F.struct(F.lit(0).cast("long").alias("units"), F.lit(0).cast("long").alias("chars"), F.lit(False).alias("found"))

    def step(acc: Column, b: Column) -> Column:
        upto = acc["units"] + b["units"] - b["joined"]
        here = ~acc["found"] & (upto > unit)
        before = F.slice(units(b["text"], runs), F.lit(1), (unit - acc["units"] + b["joined"]).cast("int"))
        chars = F.when(acc["found"], acc["chars"]).when(here, acc["chars"] + F.char_length(F.array_join(before, "")))
        return F.struct(
            upto.alias("units"),
            chars.otherwise(acc["chars"] + F.char_length(b["text"])).alias("chars"),
            (acc["found"] | here).alias("found"),
        )

    return F.aggregate(blocks, zero, step, lambda acc: acc["chars"])


def draws(doc_id: Column, seed: int = 1) -> list[Column]:
    """Four numbers of 32 bits from the digest of ``seed`` and the id; a null id is an empty string there."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def rebuilt(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of: texts of a form with sentinels hold none themselves."""

    def between(first: str, second: str) -> Column:
        """What stands from the leading ``first`` to ``second``, and from there to MIDDLE, in the order of the text."""
        head = F.substring(F.substring_index(output, second, 1), F.lit(1 + len(first)), F.char_length(output))
        rest = F.substring_index(F.substring_index(output, second, -1), MIDDLE, 1)
        middle = F.substring_index(output, MIDDLE, -1)
        return F.concat(head, middle, rest) if first == PREFIX else F.concat(rest, middle, head)

    return F.when(form == "plain", output).when(form == "psm", between(PREFIX, SUFFIX)).otherwise(between(SUFFIX, PREFIX))


def fill_in_middle(
    docs: DataFrame, runs: Sequence[str] = LETTERS, rate: int = 90, spm_rate: int = 20, seed: int = 1, block: int = BLOCK
) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars and output of every row of ``docs``.

    Of a hundred documents about ``rate`` are cut at two units drawn by id, of these ``spm_rate`` put the suffix first.  Empty and
    null texts (which have no units) and texts that hold a sentinel stay plain; a plain form has no prefix_chars and middle_chars.
    Rows of one id are drawn alike, each with its own text; repeated rows come back as often as they stand; no rows: none.
    """
    rows = doc_rows(docs).select(public_id().alias("doc_id"), "text")
    rows = rows.withColumn("parts", F.regexp_extract_all("text", F.lit(f"(?s).{{1,{block}}}"), F.lit(0)))
    rows = rows.withColumn("blocks", _blocks(F.col("parts"), runs)).drop("parts")
    total = F.aggregate("blocks", F.lit(0).cast("long"), lambda n, b: n + b["units"] - b["joined"])
    h1, h2, h3, h4 = draws(F.col("doc_id"), seed)
    holds = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    form = F.when((F.col("text") == "") | holds | (h3 % 100 >= rate), F.lit("plain"))
    form = form.when(h4 % 100 < spm_rate, F.lit("spm")).otherwise(F.lit("psm"))
    rows = rows.withColumns({"n": total, "form": form})
    rows = rows.withColumns({"u": h1 % (F.col("n") + 1), "v": h2 % (F.col("n") + 1)})
    rows = rows.withColumns({"u": F.least("u", "v"), "v": F.greatest("u", "v")})
    cut = F.struct(_place(F.col("blocks"), F.col("u"), runs).alias("a"), _place(F.col("blocks"), F.col("v"), runs).alias("b"))
    rows = rows.withColumn("cut", F.when(F.col("form") != "plain", cut)).drop("blocks", "u", "v")
    first, second = F.col("cut.a").cast("int"), F.col("cut.b").cast("int")
    text = F.col("text")
    prefix, middle = F.substring(text, F.lit(1), first), F.substring(text, first + 1, second - first)
    suffix = F.substring(text, second + 1, F.char_length(text))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    output = F.when(F.col("form") == "plain", text).when(F.col("form") == "spm", spm).otherwise(psm)
    return rows.select(
        "doc_id",
        "n",
        "form",
        F.col("cut.a").alias("prefix_chars"),
        (F.col("cut.b") - F.col("cut.a")).alias("middle_chars"),
        output.alias("output"),
    )
