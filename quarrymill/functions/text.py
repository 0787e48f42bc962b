"""Text, identifier and query-language expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9; a hyphen separates, and so does every other character."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def _ascii_forms() -> tuple[dict[str, str], dict[str, str]]:
    """What compatibility decomposition leaves of each character in ASCII, where that is one letter and where it is several."""
    forms = {chr(c): unicodedata.normalize("NFKD", chr(c)).encode("ascii", "ignore").decode() for c in (*range(0x80, 0x3400), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F))}
    return {c: f for c, f in forms.items() if len(f) == 1}, {c: f for c, f in forms.items() if len(f) > 1}


_ONE, _SEVERAL = _ascii_forms()


def slug(text: Column) -> Column:
    """Lower-case ASCII words joined by hyphens: accents, ligatures and other compatible forms become ASCII, other characters beyond it are left out."""
    parts = F.create_map(*[F.lit(x) for pair in _SEVERAL.items() for x in pair])
    spelled = F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.element_at(parts, c), c)), "")
    whole = F.when(text.rlike(f"[{''.join(_SEVERAL)}]"), spelled).otherwise(text)
    flat = F.lower(F.regexp_replace(F.translate(whole, "".join(_ONE), "".join(_ONE.values())), r"[^\x00-\x7f]", ""))
    return F.regexp_replace(F.regexp_replace(flat, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def path_safe(text: Column) -> Column:
    """An identifier for paths: other characters than letters, digits, dot, hyphen and underscore become one hyphen; null if nothing is left."""
    flat = F.regexp_replace(F.regexp_replace(F.trim(text), "[^A-Za-z0-9._-]+", "-"), "^[.-]+|[.-]+$", "")
    return F.when(flat != "", flat)


def fixture_key(clip: Column, aliases: tuple[str, ...] = ()) -> Column:
    """The first three hyphen-separated parts of an id, after known suffixes are taken off."""
    for alias in aliases:
        clip = F.when(clip.endswith(alias), F.substring(clip, F.lit(1), F.length(clip) - len(alias))).otherwise(clip)
    return F.array_join(F.slice(F.split(clip, "-"), 1, 3), "-")


def canonical_name(text: Column) -> Column:
    """Trimmed and lower-case with single spaces."""
    return F.regexp_replace(F.lower(F.trim(text)), r"\s+", " ")


def half_of(position: Column) -> Column:
    """The half of a game time such as "1 - 12:30"."""
    return F.trim(F.split_part(position, F.lit("-"), F.lit(1))).try_cast("int")


def match_clock(half: Column, seconds: Column) -> Column:
    """MM:SS.s of the match; the second half starts at 45 minutes."""
    total = seconds + F.when(half == 2, 2700).otherwise(0)
    minutes = F.floor(total / 60)
    return F.format_string("%02d:%04.1f", minutes.cast("int"), total - minutes * 60)


def clip_half(half: Column, clip: Column) -> Column:
    """The stated half, else the one in an id part such as "-h2-", else that of an id that begins with it."""
    inner, first = F.regexp_extract(clip, r"(?i)(?:^|[-_])h([12])(?:[-_]|$)", 1), F.regexp_extract(clip, r"(?i)^h([12])", 1)
    from_id = F.when(inner != "", inner).otherwise(first)
    return F.coalesce(half, F.when(from_id != "", from_id.cast("int")))


def without_suffix(label: Column, suffix: str = "_goalkeeper") -> tuple[Column, Column]:
    """(label without the suffix, whether it had it)."""
    has = label.endswith(suffix)
    return F.when(has, F.substring(label, F.lit(1), F.length(label) - len(suffix))).otherwise(label), has


def confidence_band(confidence: Column) -> Column:
    return F.when(confidence < 0.60, "low").when(confidence < 0.85, "medium").otherwise("high")


def query_spec(text: Column) -> tuple[Column, Column]:
    """(id, prompt) of "id=prompt"; both null where either is empty."""
    key, prompt = (F.trim(F.regexp_extract(text, r"(?s)^([^=]*)=(.*)$", k)) for k in (1, 2))
    good = (key != "") & (prompt != "")
    return F.when(good, key), F.when(good, prompt)


def loose_true(value: Column) -> Column:
    """True for the word true in any case; false for anything else, null included."""
    return F.coalesce(F.lower(F.trim(value.cast("string"))) == "true", F.lit(False))


def hash_fraction(key: Column) -> Column:
    """A stable number from 0 to 1 of a key: the first 8 bytes of its SHA-256 over 2^64 - 1."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / 18446744073709551615.0


def content_fingerprint(*columns: str) -> Column:
    """SHA-256 of the row's JSON."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def retrieval_text(*parts: Column) -> Column:
    """Non-null parts as sentences of one searchable text."""
    return F.concat_ws(". ", *parts)


def words_of(query: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.replace(F.lower(query), F.lit("-"), F.lit(" ")), r"\s+", " ")), " ")


def _side(query: Column) -> Column:
    words = words_of(query)
    left, right = F.array_contains(words, "left"), F.array_contains(words, "right")
    return F.when(left & ~right, "left").when(right & ~left, "right")


def expand_query(query: Column) -> Column:
    """A query that names one flank, with the catalogue's description of that flank after it."""
    # fixed text of the catalogue's descriptions
    extra = F.format_string(
        ". %s touchline trap. Pressure is concentrated around the %s touchline with defenders positioned inside the ball. Tactical class: trap %s.", F.initcap(_side(query)), _side(query), _side(query)
    )
    return F.when(_side(query).isNull(), query).otherwise(F.concat(query, extra))


def flank_class(query: Column) -> Column:
    """trap_left or trap_right where a query about pressing names one flank."""
    # fixed values: the words that make a query one about pressing
    about = F.array(*[F.lit(w) for w in ("press", "pressing", "pressure", "trap", "touchline", "flank")])
    return F.when(F.arrays_overlap(words_of(query), about), F.concat(F.lit("trap_"), _side(query)))


#: The query patterns, first match first; None stands for queries that the catalogue can't answer.
INTENTS = [
    (None, r"\b(corner(?:\s+kick)?|free\s+kick|penalty|red\s+card|throw[\s-]?in)\b"),
    ("low_block", r"\b(low block|deep block|defend(?:ing)? deep|compact near (?:their|the) (?:box|penalty area)|most players behind the ball)\b"),
    ("high_press_wing", r"\b(wing press|wide high press|press(?:ing)? (?:near|toward|on) (?:the )?(?:wing|flank|touchline)|wide pressing lane)\b"),
    ("high_press_central", r"\b(central high press|high press through the cent(?:er|re)|press(?:ing)? central build[\s-]?up|central pressure)\b"),
    ("medium_press", r"\b(medium press|mid block|middle third press|middle-third pressure)\b"),
]


def intent(query: Column) -> tuple[Column, Column]:
    """(unsupported, preferred class): the first pattern that the query holds decides.

    "penalty" alone makes a query unsupported, even as part of "penalty area": the order
    of the patterns is kept as it is specified.
    """
    clean = F.replace(F.lower(query), F.lit("-"), F.lit(" "))
    unsupported = clean.rlike(INTENTS[0][1])
    preferred = F.when(unsupported, F.lit(None).cast("string"))
    for label, pattern in INTENTS[1:]:
        preferred = preferred.when(clean.rlike(pattern), F.lit(label))
    return unsupported, preferred


def first_object(text: Column) -> Column:
    """The first balanced {...} of a free text, as a string; null if there is none.

    Braces inside JSON strings don't count. The scan is a fold over the characters.
    """
    start = F.instr(text, "{")
    chars = F.split(F.substring(text, start, F.length(text)), "")
    zero = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"))

    def step(s: Column, c: Column) -> Column:
        quote = (c == '"') & ~s["escaped"]
        depth = s["depth"] + F.when(s["quoted"], 0).when(c == "{", 1).when(c == "}", -1).otherwise(0)
        closes = (s["end"] == 0) & (depth == 0) & (c == "}") & ~s["quoted"]
        return F.struct(
            depth.alias("depth"), (s["at"] + 1).alias("at"), F.when(closes, s["at"] + 1).otherwise(s["end"]).alias("end"),
            F.when(quote, ~s["quoted"]).otherwise(s["quoted"]).alias("quoted"), (s["quoted"] & (c == "\\") & ~s["escaped"]).alias("escaped"),
        )

    end = F.aggregate(chars, zero, step, lambda s: s["end"])
    return F.when((start > 0) & (end > 0), F.substring(text, start, end))


def probability(value: Column) -> Column:
    """A finite number from 0 to 1 given as text or number, else null; booleans are no numbers."""
    number = F.when(~F.lower(value.cast("string")).isin("true", "false"), value.cast("string").try_cast("double"))
    return F.when(~F.isnan(number) & number.between(0, 1), number)


#: Words in a direction's status or source that make it unusable.
BAD_DIRECTION = "ambiguous|abstain|invalid|unknown|undetermined|unavailable"


def direction_trusted(confident: Column, status: Column, source: Column, raw: Column, label: Column) -> Column:
    """Explicitly confident, no bad marker in status or source, raw direction of one unit and a label that agrees."""
    clean = lambda c: F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), "[- ]", "_")
    agrees = F.lower(F.trim(label)) == F.when(raw == 1, "left_to_right").otherwise("right_to_left")
    good = confident & ~clean(status).rlike(BAD_DIRECTION) & ~clean(source).rlike(BAD_DIRECTION) & raw.isin(-1, 1) & agrees
    return F.coalesce(good, F.lit(False))


def resolve_direction(manifest: Column, registry: Column, inferred: Column) -> tuple[Column, Column]:
    """(direction, where it is from): the manifest before the registry before inference; anything but -1 and 1 is absent."""
    one = lambda c: F.when(c.isin(-1, 1), c)
    source = F.when(one(manifest).isNotNull(), "manifest").when(one(registry).isNotNull(), "registry").when(one(inferred).isNotNull(), "inference").otherwise("none")
    return F.coalesce(one(manifest), one(registry), one(inferred)), source
