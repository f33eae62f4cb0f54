"""Fill-in-middle: texts cut into prefix, middle and suffix at line ends, and written in another order.

A text has ``n`` units (lines with their line feed, the last perhaps without), counted by ``regexp_count``. Each row
gets a pattern of its own, ``\\A((?:unit){a}+)((?:unit){b-a}+)(.*+)\\z``, whose counted quantifiers are possessive: a
match never goes back, so it takes one pass over the text and constant stack however many lines there are. One match
captures prefix, middle and suffix together.

The cuts and the form come from the sha256 of the id and a seed, not from a random state: a lost task gives the same
rows again, and so does any other layout of the table. Everything is a projection of the scan: nothing is shuffled.

* A null or empty text, and one that contains a mark, stays as it is (form ``plain``).
* A null id is hashed as ``null``; rows with the same id are cut by the same hash values, repeated rows alike.
* Further columns are ignored, whatever their names. No rows give no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveknn.llm.common import whole_text

UNIT = r"[^\n]*\n|[^\n]+"
_POSSESSIVE_UNIT = r"[^\n]*+\n|[^\n]++"
MARKS = ("<P>", "<S>", "<M>")  # of prefix, suffix, middle
_CUT = MARKS[0]  # stands between the three captures; no text that is cut contains it
SEED = 7
FIM_PERCENT = 100
SPM_PERCENT = 50


def _check_marks(marks: tuple[str, str, str]) -> None:
    """A mark's place in an output must be beyond doubt, whatever stands beside it."""
    for a in marks:
        for b in marks:
            if not a or (a is not b and a in b) or any(a.endswith(b[:k]) for k in range(1, len(b))):
                raise ValueError(f"marks must not be empty, hold each other or overlap: {marks}")


def _draw(doc_id: Column, seed: int, number: int) -> Column:
    """The ``number``-th 32 bits of the row's hash, as an unsigned number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256)
    return F.conv(F.substr(digest, F.lit(8 * number - 7), F.lit(8)), 16, 10).cast("long")


def _any_mark(marks: tuple[str, ...]) -> str:
    return "|".join(re.escape(m) for m in marks)


def cut_units(text: Column, before: Column, inside: Column) -> Column:
    """``[prefix, middle, suffix]`` of a text without marks: ``before`` units, ``inside`` units, the rest; one match."""
    unit = f"(?:{_POSSESSIVE_UNIT})"
    pattern = F.concat(
        F.lit(rf"\A({unit}{{"), before.cast("string"), F.lit(rf"}}+)({unit}{{"), inside.cast("string"), F.lit(r"}+)((?s:.*+))\z")
    )
    return F.split(F.regexp_replace(text, pattern, F.lit(f"$1{_CUT}$2{_CUT}$3")), _CUT, -1)


def fill_in_middle(
    docs: DataFrame,
    seed: int = SEED,
    fim_percent: int = FIM_PERCENT,
    spm_percent: int = SPM_PERCENT,
    marks: tuple[str, str, str] = MARKS,
) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output``, one row per document.

    ``fim_percent`` of the texts are cut, the others are ``plain``; of those ``spm_percent`` are written suffix first
    (``spm``), the others prefix first (``psm``). The middle always comes last.
    """
    _check_marks(marks)
    p, s, m = (F.lit(x) for x in marks)
    rows = docs.select("doc_id", whole_text().alias("text"))
    rows = rows.withColumns({f"h{i}": _draw(F.col("doc_id"), seed, i) for i in range(1, 5)})
    rows = rows.withColumn("n", F.regexp_count("text", F.lit(UNIT)).cast("long"))
    plain = (F.length("text") == 0) | F.col("text").rlike(_any_mark((*marks, _CUT))) | (F.col("h3") % 100 >= fim_percent)
    rows = rows.withColumn("form", F.when(plain, "plain").when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm"))
    one, two = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    before, behind = F.least(one, two), F.greatest(one, two)
    rows = rows.withColumn("cut", F.when(F.col("form") != "plain", cut_units(F.col("text"), before, behind - before)))
    prefix, middle, suffix = (F.get("cut", F.lit(i)) for i in range(3))
    output = (
        F.when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle))
        .when(F.col("form") == "spm", F.concat(s, suffix, p, prefix, m, middle))
        .otherwise(F.col("text"))
    )
    return rows.select(
        "doc_id",
        "n",
        "form",
        F.length(prefix).cast("long").alias("prefix_chars"),
        F.length(middle).cast("long").alias("middle_chars"),
        output.alias("output"),
    )


def restore(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made from."""
    parts = F.split(output, _any_mark(marks), -1)
    one, two, three = (F.get(parts, F.lit(i)) for i in (1, 2, 3))
    return F.when(form == "psm", F.concat(one, three, two)).when(form == "spm", F.concat(two, three, one)).otherwise(output)


def fill_in_middle_report(docs: DataFrame) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256``."""
    done = fill_in_middle(docs)
    return done.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restore(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"),
    )
