"""Text parsing as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fraction characters of printed dimensions.
VULGAR = {"½": 0.5, "¼": 0.25, "¾": 0.75, "⅛": 0.125, "⅜": 0.375, "⅝": 0.625, "⅞": 0.875}
MIN_FEET, MAX_FEET = 0.5, 500.0
#: Name tokens that hint at a layer's role, in order of precedence.
ROLE_TOKENS = (
    ("wall_structural", ("wall", "walls", "walll")),
    ("column", ("column", "columns", "colum", "col")),
    ("beam_overhead", ("beam", "beams")),
    ("door", ("door", "doors", "sliding", "pocket")),
    ("window", ("window", "windows", "win", "glaz")),
    ("stair", ("stair", "stairs", "sstair")),
    ("furniture", ("furniture", "furn", "fur", "loose")),
    ("electrical", ("electrical", "ele", "bulb", "fan", "socket", "switch", "light", "conduit")),
    ("plumbing", ("plumbing", "sanitary", "sink", "wc", "basin", "toilet", "drain")),
    ("grid", ("grid", "grids")),
    ("dimension", ("dim", "dimension", "dimensions")),
    ("text_label", ("text", "tex", "label")),
    ("title_block", ("sheet", "title", "format")),
    ("vehicle", ("car", "cars", "vehicle")),
)
def _number(text: Column) -> Column:
    return F.when(text != "", text.cast("double"))


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.transform(F.array(value), lambda x: use(x))[0]


def _digits(text: Column, most: int) -> Column:
    """A run of 1 to ``most`` digits as a number, else null."""
    return F.when(text.rlike(f"^[0-9]{{1,{most}}}$"), text.cast("double"))


def parse_feet(text: Column) -> Column:
    """Feet of a printed dimension such as 14'-5 1/2", or null: inches stay under 12 and feet within the bounds.

    The foot mark parts feet from inches. Inches are a whole number, a fraction or both; where both run together before the
    slash, the whole number takes up to two digits and leaves the fraction at least one.
    """
    return _let(F.trim(F.rtrim(F.upper(F.trim(text)), F.lit("X"))), _feet_of)


def _feet_of(t: Column) -> Column:
    after = F.when(F.instr(t, "'") > 0, F.trim(F.substr(t, F.instr(t, "'") + 1)))
    after = F.trim(F.regexp_replace(F.trim(F.regexp_replace(after, "^-", "")), "[\"']$", ""))
    spaced = F.trim(F.regexp_replace(F.regexp_replace(after, r"\s*/\s*", "/"), "([" + "".join(VULGAR) + "])", " $1"))
    inches = _let(F.filter(F.split(spaced, r"\s+"), lambda w: w != ""), _inches_of)
    feet = _digits(F.trim(F.substring_index(t, "'", 1)), 3)
    return _let(F.struct(feet.alias("feet"), inches.alias("inches")), lambda x: _let(x["feet"] + x["inches"] / 12, lambda whole: F.when((x["inches"] < 12) & whole.between(MIN_FEET, MAX_FEET), whole)))


def _inches_of(words: Column) -> Column:
    n, last, first = F.size(words), F.try_element_at(words, F.lit(-1)), F.try_element_at(words, F.lit(1))
    glyph = F.coalesce(*[F.when(last == c, F.lit(v)) for c, v in VULGAR.items()])
    over, under = F.substring_index(last, "/", 1), F.substring_index(last, "/", -1)
    together = F.least(F.length(over) - 1, F.lit(2))  # digits of the whole number in front of a fraction
    split_whole = F.when(together > 0, _digits(F.substr(over, F.lit(1), together), 2)).otherwise(0.0)
    quotient = lambda upper: F.when(_digits(under, 2) != 0, _digits(upper, 2) / _digits(under, 2))
    return (
        F.when(n == 0, 0.0)
        .when((n == 1) & glyph.isNotNull(), glyph)
        .when((n == 2) & glyph.isNotNull(), _digits(first, 2) + glyph)
        .when((n == 1) & last.contains("/"), split_whole + quotient(F.substr(over, together + 1)))
        .when((n == 2) & last.contains("/"), _digits(first, 2) + quotient(over))
        .when(n == 1, _digits(first, 2))
    )


def parse_feet_group(text: Column) -> Column:
    """All dimensions that a text states: the whole if it is one, else those of its parts between multiplication signs."""
    parts = F.filter(F.transform(F.split(text, "[xX×*]"), lambda x: parse_feet(x)), lambda x: x.isNotNull())
    return _let(parse_feet(text), lambda whole: F.when(whole.isNotNull(), F.array(whole)).otherwise(parts))


def clean_label(text: Column) -> Column:
    """Multi-line text without its formatting codes, on one line. A code is a backslash and a letter: P and N break the line,
    S stacks two parts about a separator up to its semicolon, and any other ends with its semicolon."""

    def plain(part: Column) -> Column:
        code, body = F.upper(F.substr(part, F.lit(1), F.lit(1))), F.substr(part, F.lit(2))
        inside, behind = F.substring_index(body, ";", 1), F.substr(body, F.instr(body, ";") + 1)
        closed = F.instr(body, ";") > 0
        stacked = F.translate(inside, "^#", "//")
        return (
            F.when(code.isin("P", "N"), F.concat(F.lit(" "), body))
            .when(closed & part.startswith("S") & (F.instr(stacked, "/") > 0), F.concat(stacked, behind))
            .when(closed & code.rlike("[A-Z]"), behind)
            .otherwise(F.concat(F.lit("\\"), part))
        )

    joined = _let(F.split(text, r"\\"), lambda parts: F.concat(parts[0], F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), plain), "")))
    return F.trim(F.regexp_replace(F.translate(joined, "{}", ""), r"\s+", " "))


def _measure(text: Column) -> Column:
    """Feet at the beginning of a text: a number, the foot mark, and perhaps inches behind a dash; else null."""
    feet = F.trim(F.substring_index(text, "'", 1))
    after = F.ltrim(F.regexp_replace(F.ltrim(F.substr(text, F.instr(text, "'") + 1)), "^-", ""))
    inches = _number(F.regexp_extract(after, "^[0-9]+([.][0-9]+)?", 0))
    return F.when((F.instr(text, "'") > 0) & feet.rlike("^[0-9]+([.][0-9]+)?$"), feet.cast("double") + F.coalesce(inches, F.lit(0.0)) / 12)


def _behind(text: Column, word: str, read) -> Column:
    """The first value that ``read`` finds behind ``word``."""
    parts = F.transform(F.split(text, f"\\b{word}"), lambda x, i: F.when(i > 0, read(x)))
    return F.try_element_at(F.filter(parts, lambda x: x.isNotNull()), F.lit(1))


def _level(text: Column) -> Column:
    return _let(
        F.ltrim(F.regexp_replace(text, "^[.]", "")),
        lambda t: F.when(t.startswith("-"), -1.0).when(t.startswith("+"), 1.0) * _let(F.ltrim(F.substr(t, F.lit(2))), _measure),
    )


def _clear(text: Column) -> Column:
    def rest(t: Column) -> Column:
        return F.when(t.startswith("HEIGHT"), F.substr(t, F.lit(7))).when(t.startswith("HT"), F.substr(t, F.lit(3)))

    bare = F.ltrim(F.regexp_replace(_let(F.ltrim(text), rest), "^[.]", ""))
    return _let(F.ltrim(F.regexp_replace(bare, "^[-:=]", "")), _measure)


def label_attributes(text: Column) -> dict[str, Column]:
    """What a room label states: level_offset_ft, clear_height_ft, double_height, below and pool."""
    t = clean_label(text)
    upper = F.upper(t)
    words = F.filter(F.split(F.regexp_replace(upper, r"([^A-Z0-9_\s])", " $1 "), r"\s+"), lambda w: w != "")
    line = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    says = lambda phrase: line.contains(f" {phrase} ")
    return {
        "label": t,
        "level_offset_ft": F.round(_behind(upper, "LVL", _level), 9),
        "clear_height_ft": F.round(_behind(upper, "CLEAR", _clear), 9),
        "double_height": line.rlike(" DOUBLE ?H[A-Z]*T ") | says("OPEN TO ABOVE"),
        "below": says("BELOW") | says("OPEN TO SKY"),
        "pool": says("POOL"),
    }


def token_role(name: Column) -> Column:
    """The role that a layer's name hints at, or ignore."""
    words = F.regexp_extract_all(F.lower(name), F.lit("[a-z]+"), F.lit(0))
    return F.coalesce(*[F.when(F.arrays_overlap(words, F.array(*map(F.lit, tokens))), F.lit(role)) for role, tokens in ROLE_TOKENS], F.lit("ignore"))


def is_uninformative(name: Column) -> Column:
    """Names that say nothing: empty, defpoints, digits only, one character."""
    n = F.trim(name)
    return (n == "") | (F.lower(n) == "defpoints") | n.rlike("^[0-9]+$") | (F.length(n) == 1)


#: Feet of one unit.
UNIT_FEET = {"mm": 1 / 304.8, "cm": 1 / 30.48, "m": 1 / 0.3048, "ft": 1.0, "in": 1 / 12}
#: Floor words, their names and ranks from the ground up.
FLOOR_WORDS = {
    "basement": ("Basement", 0), "stilt": ("Stilt", 1), "parking": ("Parking", 1), "ground": ("Ground floor", 2), "mezzanine": ("Mezzanine", 3), "first": ("First floor", 4),
    "second": ("Second floor", 5), "third": ("Third floor", 6), "fourth": ("Fourth floor", 7), "fifth": ("Fifth floor", 8), "sixth": ("Sixth floor", 9), "seventh": ("Seventh floor", 10),
    "terrace": ("Terrace", 20), "roof": ("Roof", 21),
}
#: Words that make a caption a note, and words of which a caption of a floor has one.
FLOOR_NOTE_WORDS = ("up to", "upto", "section", "elevation", "staircase", "stair case", "below", "above", "existing")
FLOOR_KIND_WORDS = ("floor", "plan", "level")
#: Ratios that mean a confusion of units.
UNIT_RATIOS = ((25.4, "millimetres read as inches"), (12.0, "feet read as inches"), (304.8, "millimetres read as feet"), (30.48, "centimetres read as feet"), (2.54, "centimetres read as inches"))


def explicit_length(text: Column) -> Column:
    """Feet of a printed dimension or of a number with its unit."""
    pattern = "^\\s*([0-9]+(?:\\.[0-9]+)?)\\s*(mm|cm|m|ft|in)\\s*$"
    t = F.lower(text)
    unit = F.coalesce(*[F.when(F.regexp_extract(t, pattern, 2) == u, F.lit(v)) for u, v in UNIT_FEET.items()])
    value = _number(F.regexp_extract(t, pattern, 1)) * unit
    return F.coalesce(parse_feet(text), F.when(value > 0, value))


def floor_word(text: Column) -> Column:
    """The floor word of a caption that names a floor or plan and is no note; else null."""
    word = F.regexp_extract(F.lower(text), "\\b(" + "|".join(FLOOR_WORDS) + ")\\b", 1)
    said = F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+|[^\\sa-z0-9_]"), F.lit(0)), " "), F.lit(" "))
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: said.contains(F.concat(F.lit(" "), w, F.lit(" "))))
    return F.when(~has(FLOOR_NOTE_WORDS) & has(FLOOR_KIND_WORDS) & (word != ""), word)


def reason_class(reason: Column) -> Column:
    """The wall class that a reviewer's words ask for, or an empty text."""
    has = lambda *words: F.lower(reason).rlike("|".join(words))
    return F.when(has("railing"), "railing").when(has("pool", "-z"), "pool_edge").when(has("boundary", "compound", "site wall"), "site_wall").when(has("parapet"), "parapet").otherwise("")


def unit_hint(ratio: Column) -> Column:
    """What confusion of units a ratio suggests, or null."""
    return F.coalesce(*[F.when(F.abs(ratio - f) / f <= 0.01, F.lit(said)) for f, said in UNIT_RATIOS])


def nfkc(text: Column) -> Column:
    """The compatibility form of a text, by the ICU library that Spark brings for its collations."""
    plain = ~text.rlike("[^\\x00-\\x7F]")
    return F.when(plain | text.isNull(), text).otherwise(F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(text, F.lit("")), F.lit(True)))
