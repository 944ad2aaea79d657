"""Several values packed in one field: author lists split into one row per author.

Quote-parity splitting: the field is split on quote characters, odd pieces are literal values, even pieces are split on
delimiters, and SQL array folds put family names back to their given names and suffixes to their names, with ordinals.
Everything is a Column expression: no Python worker, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Private-use signs that stand for a doubled quote and for a strong delimiter while a field is folded.
DOUBLED, STRONG = "\ue000", "\ue001"

# Words that make a name the name of a group, and name suffixes.
GROUP_WORDS = r"(?i)\b(group|consortium|cons\.?|laboratory|lab\.?|centre|center|institute|inst\.?|network|initiative|society|committee|collaboration|team|project|association|department|dept\.?|alliance|council|board|unit)(?=\s|$)"
SUFFIX = r"(?i)^(jr|sr|jnr|snr|junior|senior|ii|iii|iv|ph\.?\s?d|m\.?\s?d)\.?$"
# Given names or initials that may follow a family name and a comma.
GIVEN = r"^(\p{Lu}\p{L}*[.]?([-\s]?\p{Lu}[.])*|\p{Lu}\p{L}+(\s\p{L}{1,2}[.]?)*|(\p{Lu}[.]?[\s-]?){1,4})(\s*“[^”]*”|\s*\ue000[^\ue000]*\ue000)?$"
FAMILY = r"^((van|von|de|der|den|del|della|da|di|du|la|le|dos|ten|ter|al|el|bin|ibn)\s){0,3}\p{Lu}[\p{L}\p{M}'’-]+$"
_INITIALS = r"^(\p{Lu}\p{M}*[.]?[\s-]?){1,4}$"


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def split_packed(field: Column) -> Column:
    """ARRAY<STRING> of the values of one packed field, in order, without empty values.

    null gives an empty array, so does a text of delimiters alone. Quotes guard delimiters; a doubled quote inside quotes is
    one quote sign; an unbalanced last quote is an ordinary character. A field without delimiters is one value.
    """
    f = F.coalesce(field, F.lit(""))
    # Brackets of a JSON list, escaped and doubled quotes, footnote marks.
    f = F.regexp_replace(f, r"^\s*\[(.*)\]\s*$", "$1")
    f = F.regexp_replace(f, r'\\"', DOUBLED)
    pieces = F.split(f, '"', -1)
    balanced = F.size(pieces) % 2 == 1
    pieces = F.when(balanced, pieces).otherwise(F.array(F.regexp_replace(f, '"', DOUBLED)))
    # A quoted piece that touches no delimiter (a nickname inside a name) is no literal value but belongs to its name.
    flat = F.transform(
        F.sequence(F.lit(0), F.size(pieces) - 1),
        lambda i: F.struct((i % 2 == 1).alias("lit"), F.get(pieces, i).alias("t"), F.coalesce(F.get(pieces, i - 1), F.lit("")).alias("b"), ((F.get(pieces, i) == "") & (i > 0) & (i < F.size(pieces) - 1)).alias("doubled")),
    )
    inside = lambda x: x["lit"] & x["b"].rlike(r"[\p{L}.]\s*$") & ~x["b"].rlike(r"(?i)\b(and|und|et|y)\s*$")
    mark = lambda x: (
        F.when(inside(x), F.concat(F.lit(DOUBLED), x["t"], F.lit(DOUBLED)))
        .when(x["lit"], F.concat(F.lit(STRONG + "\ue002"), x["t"], F.lit(STRONG)))
        .when(x["doubled"], F.lit("\ue003"))
        .otherwise(_delimit(x["t"]))
    )
    # Nothing between two literals is a doubled quote inside one.
    joined = F.regexp_replace(F.array_join(F.transform(flat, mark), ""), "\ue001\ue003\ue001\ue002", DOUBLED)
    joined = F.translate(joined, "\ue003", "")
    strong = F.split(joined, STRONG)
    parts = F.flatten(F.transform(strong, _values_of_piece))
    clean = F.transform(parts, lambda x: _trim(F.regexp_replace(x, DOUBLED, '"')))
    return F.filter(clean, lambda x: x.rlike(r"[\p{L}\p{N}]"))


def _delimit(t: Column) -> Column:
    """Even piece: footnote marks go, strong delimiters become one sign. Commas stay for the fold."""
    t = F.regexp_replace(t, r"(?<=[\p{L}\p{M}.)])[  ]?(?:[0-9]{1,2}(?:\s?,\s?[0-9]{1,2})*(?![\p{L}0-9])|[¹²³⁰-⁹](?:[,˒]?[¹²³⁰-⁹])*|[*∗†‡§¶#]+)+(?:,?[*∗†‡§¶#]+)*", "")
    t = F.regexp_replace(t, r"[;|/·•・、；｜\r\n\t  ]+", STRONG)
    # "&" and a spoken "and" divide unless they stand inside the name of a group ("... on Bone and Joint Loading").
    t = F.regexp_replace(t, r"\s*,?\s*[&＆]\s*", STRONG)
    return F.regexp_replace(t, r"(?i),?\s+(?<!\b(?:on|for|of|in)\s{1,3}\p{L}{1,40}\s{1,3})(?:and|und)\s+(?=\S)", STRONG)


def _values_of_piece(p: Column) -> Column:
    """Comma parts of one piece folded into values; a literal piece (marked) is one value as it stands."""
    parts = F.filter(F.transform(F.split(F.regexp_replace(p, "[，،]", ","), ","), _trim), lambda x: x != "")
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"), F.lit(False).alias("full"))

    def step(acc: Column, x: Column) -> Column:
        pending = acc["open"]
        suffix = pending.isNotNull() & x.rlike(SUFFIX)
        given = pending.isNotNull() & ~acc["full"] & pending.rlike(FAMILY) & ~pending.rlike(GROUP_WORDS) & x.rlike(GIVEN) & ~x.rlike(GROUP_WORDS)
        initials = pending.isNotNull() & ~acc["full"] & ~pending.rlike(r"\.\s*\p{L}") & x.rlike(_INITIALS) & ~pending.rlike(r"\s\p{Lu}{1,3}$")
        glue = suffix | given | initials
        return F.struct(
            F.when(glue | pending.isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(pending))).alias("done"),
            F.when(glue, F.concat(pending, F.lit(", "), x)).otherwise(x).alias("open"),
            F.when(suffix, acc["full"]).when(glue, F.lit(True)).otherwise(F.lit(False)).alias("full"),
        )

    folded = F.aggregate(parts, empty, step, lambda acc: F.when(acc["open"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))
    return F.when(p.startswith("\ue002"), F.array(F.regexp_replace(p, "\ue002", ""))).otherwise(folded)


def explode_packed(df: DataFrame, field: str, value: str = "value", pos: str = "pos", at_least: int = 1) -> DataFrame:
    """One row per value of ``field`` with its place counted from 1; rows with fewer than ``at_least`` values give none.

    All other columns stay. A column of the input named like ``value`` or ``pos`` is replaced.
    """
    tmp = "__packed_values"
    keep = [c for c in df.columns if c not in (value, pos)]
    split = df.withColumn(tmp, split_packed(F.col(f"`{field}`")))
    if at_least > 1:
        split = split.where(F.size(tmp) >= at_least)
    return split.select(*[F.col(f"`{c}`") for c in keep], F.posexplode(tmp).alias("__p", value)).withColumn(pos, F.col("__p") + 1).drop("__p")
