"""Text expressions: normalisation, slugs, lenient parsing, model replies, recogniser rules."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .. import fixed_values as fv

# Single-letter accents handled inside the JVM; other letters take the
# Unicode decomposition.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
UNACCENTED = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def normalise(value: Column) -> Column:
    """Lower-cased a-z, 0-9 and @ only, accents of Latin-1 letters removed."""
    return F.regexp_replace(F.lower(F.translate(value, ACCENTED, UNACCENTED)), "[^a-z0-9@]+", "")


def fold(value: str) -> str:
    flat = unicodedata.normalize("NFKD", str(value))
    flat = "".join(c for c in flat if not unicodedata.combining(c)).lower()
    return "".join(c for c in flat if c in "abcdefghijklmnopqrstuvwxyz0123456789@")


@F.pandas_udf(T.StringType())
def _fold_any(values: pd.Series) -> pd.Series:
    return values.map(fold, na_action="ignore")


def with_normalised(df: DataFrame, value: str, name: str) -> DataFrame:
    """Full Unicode normalisation.  Text that is ASCII once Latin-1 accents are gone stays in
    the JVM; only the rest goes through Python."""
    plain = F.translate(F.col(value), ACCENTED, UNACCENTED)
    rare = plain.rlike("[^\\x00-\\x7F]")
    return df.withColumn(name, F.when(rare, _fold_any(F.when(rare, F.col(value))))
                         .otherwise(normalise(F.col(value))))


def slug(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(value, "[^A-Za-z0-9]+", "-"), "^-+|-+$", "")


def parse_bool(value: Column) -> Column:
    """true / false in any case; any other text is null."""
    text = F.lower(F.trim(value))
    return F.when(text == "true", True).when(text == "false", False)


def parse_number(value: Column, kind: str = "double") -> Column:
    """Lenient number: N/A, empty and non-numeric text become null."""
    text = F.trim(value)
    number = F.when(~F.upper(text).isin("N/A", "", "NAN"), text.try_cast("double"))
    if kind == "double":
        return number
    return F.when(number == F.floor(number), number.try_cast(kind))


def parse_timestamp(value: Column) -> Column:
    return F.trim(value).try_cast("timestamp")


# --- model replies ----------------------------------------------------------------
ENTITY_ITEMS = "array<map<string,string>>"


def reply_entities(reply: Column) -> Column:
    """Array of {key: text} items out of a fenced or chatty reply.

    Blank -> [], code fences removed, an array as is, an object -> its `entities`, else the
    first bracketed span; null when nothing parses.
    """
    text = F.trim(F.coalesce(reply, F.lit("")))
    bare = F.trim(F.regexp_replace(text, "(?m)^```(?:json)?|```$", ""))
    span = F.regexp_extract(bare, "(?s)\\[.*\\]", 0)

    whole = F.get_json_object(bare, "$")
    return (F.when(bare == "", F.from_json(F.lit("[]"), ENTITY_ITEMS))
            .when(whole.startswith("["), _array(bare))
            .when(whole.startswith("{"), _array(F.get_json_object(bare, "$.entities")))
            .when(whole.isNull() & (span != ""), _array(span)))


def _array(value: Column) -> Column:
    """Objects of a JSON array text, other items skipped; null when it is not an array."""
    valid = F.get_json_object(value, "$")
    items = F.transform(F.from_json(valid, "array<string>"),
                        lambda i: F.when(i.startswith("{"), F.from_json(i, "map<string,string>")))
    return F.when(valid.startswith("["), F.filter(items, lambda m: m.isNotNull()))


def clean_entities(items: Column) -> Column:
    """Upper-cased known types with a non-empty trimmed value."""
    typed = F.transform(F.coalesce(items, F.from_json(F.lit("[]"), ENTITY_ITEMS)), lambda m: F.struct(
        F.upper(F.trim(F.coalesce(m["type"], F.lit("")))).alias("type"),
        F.trim(F.coalesce(m["value"], F.lit(""))).alias("value")))
    return F.filter(typed, lambda e: e["type"].isin(*fv.ENTITY_TYPES) & (e["value"] != ""))


# --- recogniser rules -----------------------------------------------------------------
@dataclass(frozen=True)
class Rule:
    """One recogniser: matches of `pattern` (group 0) or of capture `group` with a base score,
    raised by `boost` when a context word precedes the match within `window` characters."""
    recogniser: str
    pattern: str
    score: float
    context: tuple[str, ...] = ()
    check: str = ""          # "luhn" keeps only numbers with a valid check digit
    needs: str = ""          # cheap pattern found in every text with a match
    window: int = 40
    boost: float = 0.35


# Rule patterns, base scores and context words.
RULES = (
    Rule("NID", r"\b\d{5}[-\s]?\d{7}[-\s]?\d\b", 0.9, ("cnic", "nid", "national", "identity"),
         needs="[0-9]{5}"),
    Rule("PASSWORD", r"\b(?=[A-Za-z0-9]{8,20}\b)(?=[^\s]*[a-z])(?=[^\s]*[A-Z])(?=[^\s]*\d)[A-Za-z0-9]+\b",
         0.5, ("password", "passwd", "pwd", "credential", "temp"),
         needs="[0-9]"),
    Rule("CREDIT_CARD", r"[0-9]{4}(?:[- ]?[0-9]{4}){3}|\b[0-9]{4}[- ]?[0-9]{6}[- ]?[0-9]{4,5}\b|\b4[0-9]{12}\b", 0.3, ("card", "credit", "visa"), "luhn",
         "[0-9]{4}"),
    Rule("EMAIL_ADDRESS", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", 0.85,
         ("email", "mail"), needs="@"),
    Rule("PHONE_NUMBER", r"\+?[0-9]{0,2}[ ]?\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|\+[0-9]{1,3}[- ]?[0-9]{3}[- ]?[0-9]{7}\b", 0.6,
         ("phone", "tel", "call"), needs=r"[0-9]\) ?[0-9]|\+[0-9]"),
    Rule("DATE_TIME", r"(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}", 0.6, ("birth", "dob"),
         needs="[0-9]-[0-9]"),
    Rule("PERSON", r"(?m)(?<=^Name: )[^\n]+", 0.85, needs="Name: "),
    Rule("LOCATION", r"(?m)(?<=^Address: )[^\n]+", 0.85, needs="Address: "),
)
CHECKED_SCORE = 1.0


def rule_hits(text: Column, rule: Rule) -> Column:
    """Array of (recogniser, start, end, score, value) of one rule over a whole text.

    Regex functions return matched text without positions; the pieces between matches give
    them back: a match starts after all earlier pieces and matches.
    """
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    pieces = F.split(text, rule.pattern, -1)
    lengths = F.transform(F.arrays_zip(pieces.alias("p"), found.alias("m")), lambda z: F.struct(
        F.length(z["p"]).alias("gap"), z["m"].alias("m")))
    empty = F.expr("cast(array() as array<struct<start:int,value:string>>)")

    def step(acc, z):
        start = acc["at"] + z["gap"]
        hit = F.struct(start.alias("start"), z["m"].alias("value"))
        return F.struct((start + F.coalesce(F.length(z["m"]), F.lit(0))).alias("at"),
                        F.when(z["m"].isNull(), acc["hits"]).otherwise(F.concat(acc["hits"], F.array(hit))).alias("hits"))

    placed = F.aggregate(lengths, F.struct(F.lit(0).alias("at"), empty.alias("hits")), step, lambda a: a["hits"])
    if rule.needs:
        likely = text.contains(rule.needs) if "[" not in rule.needs else text.rlike(rule.needs)
        placed = F.when(likely, placed).otherwise(empty)
    if rule.check == "luhn":
        placed = F.filter(placed, lambda h: F.call_function("luhn_check", F.regexp_replace(h["value"], "[^0-9]", "")))

    def scored(h):
        score = F.lit(CHECKED_SCORE if rule.check == "luhn" else rule.score)
        if rule.context and rule.check != "luhn":
            before = F.lower(F.substring(text, F.greatest(h["start"] + 1 - rule.window, F.lit(1)),
                                         F.least(h["start"], F.lit(rule.window))))
            near = F.lit(False)
            for word in rule.context:
                near = near | before.contains(word)
            score = F.when(near, F.least(F.lit(1.0), score + rule.boost)).otherwise(score)
        return F.struct(F.lit(rule.recogniser).alias("recogniser"), h["start"].alias("start"),
                        (h["start"] + F.length(h["value"])).alias("end"), score.alias("score"),
                        h["value"].alias("value"))

    return F.transform(placed, scored)
