"""Model text in and out: requests from tables, tolerant reading of answers, redaction of logs."""
from __future__ import annotations

from importlib import resources

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreweave.functions import keys as K
from loreweave.functions.textfns import is_json
from loreweave.operators.segment import detect_language

# --- Fixed values -------------------------------------------------------------------------
REPAIR_LIMIT = {"array": 16000, "object": 24000}
TRUNCATED = "\n...[truncated]"
MAX_REPAIRS = 1
DEFAULTS = {
    "title": "Untitled chapter", "source_language": "unknown", "novel_context": "No novel context provided.",
    "known_alias_surfaces_json": "[]", "known_relationships_json": "[]",
}
PLACEHOLDERS = (
    "schema_version", "prompt_id", "prompt_version", "call_profile", "chapter_num", "title", "source_language",
    "novel_context", "known_alias_surfaces_json", "known_relationships_json", "chapter_text",
)
API_KEY = "AIza[A-Za-z0-9]{12,}"
NO_MESSAGE = "provider request failed"
ALIAS_LABEL = "Tên gọi khác"
RELATION_NAMES = {
    "source_name": ("source_name", "person_a", "character_a", "source"),
    "target_name": ("target_name", "person_b", "character_b", "target"),
    "relationship_kind": ("relationship_kind", "kind"),
    "relationship_type": ("relationship_type",),
    "source_to_target_label": ("source_to_target_label", "a_to_b_label", "source_label", "relationship_label"),
    "target_to_source_label": ("target_to_source_label", "b_to_a_label", "target_label"),
}
# ------------------------------------------------------------------------------------------

TOLERANT = {"allowUnquotedControlChars": "true"}


def extract_json_block(c: Column, kind: str = "object") -> Column:
    """L1: from the first opening to the last closing bracket; null where there is none."""
    opening, closing = (r"\{", r"\}") if kind == "object" else (r"\[", r"\]")
    return F.nullif(F.regexp_extract(c, f"(?s){opening}.*{closing}", 0), F.lit(""))


def parse_tolerant_json(df: DataFrame, text_col: str, schema: str, out: str = "parsed") -> tuple[DataFrame, DataFrame]:
    """L2: (rows with the parsed value, rows that need repair). Raw control characters inside strings are
    accepted; anything after the value is not."""
    d = df.withColumn("_ok", is_json(F.col(text_col), TOLERANT)).withColumn(out, F.when(F.col("_ok"), F.from_json(text_col, schema, TOLERANT)))
    good = F.col("_ok") & F.col(out).isNotNull()
    return d.filter(good).drop("_ok"), d.filter(~good).drop("_ok", out)


def repair_queue(failed: DataFrame, text_col: str, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """L3: (repair requests, final failures). ``failed`` may carry ``attempt`` (0 at first). A request holds the whole
    text, or with ``limit`` its first characters and a mark (the original sends REPAIR_LIMIT of its kind)."""
    t = F.coalesce(text_col, F.lit(""))
    cut = t if limit is None else F.when(F.length(t) > limit, F.concat(F.left(t, F.lit(limit)), F.lit(TRUNCATED))).otherwise(t)
    d = failed if "attempt" in failed.columns else failed.withColumn("attempt", F.lit(0))
    again = d.filter(F.col("attempt") < MAX_REPAIRS).withColumn("invalid_text", cut).withColumn("attempt", F.col("attempt") + 1).drop(text_col)
    return again, d.filter(F.col("attempt") >= MAX_REPAIRS)


def coerce_aliases(c: Column) -> Column:
    """L4: alias list of text or objects -> array<struct(text, alias_type, alias_label, is_primary)>."""
    items = F.from_json(c, "array<variant>")

    def part(v: Column, name: str, kind: str = "string") -> Column:
        return F.try_variant_get(v, f"$.{name}", kind)

    def one(v: Column) -> Column:
        plain = ~F.schema_of_variant(v).startswith("OBJECT")
        return F.struct(
            F.when(plain, F.try_variant_get(v, "$", "string")).otherwise(part(v, "text")).alias("text"),
            F.when(plain, F.lit("other_alias")).otherwise(F.coalesce(part(v, "alias_type"), F.lit(""))).alias("alias_type"),
            F.when(plain, F.lit(ALIAS_LABEL)).otherwise(F.coalesce(part(v, "alias_label"), F.lit(""))).alias("alias_label"),
            F.when(plain, F.lit(False)).otherwise(F.coalesce(part(v, "is_primary", "boolean"), F.lit(False))).alias("is_primary"),
        )

    return F.transform(items, one)


def coerce_relationship(c: Column) -> list[Column]:
    """L4: columns of a relationship object that may use other field names."""
    m = F.from_json(c, "map<string,string>")
    return [F.coalesce(*[F.try_element_at(m, F.lit(n)) for n in names], F.lit("")).alias(out) for out, names in RELATION_NAMES.items()]


def load_template(name: str = "chapter_request.txt") -> str:
    return resources.files("loreweave.data").joinpath(name).read_text(encoding="utf8").strip()


def build_requests(rows: DataFrame, template: str | None = None, out: str = "user_prompt") -> DataFrame:
    """One request per row. Blank columns take their default; placeholders without a column stay."""
    text = F.lit(load_template() if template is None else template)
    for name in PLACEHOLDERS:
        if name not in rows.columns:
            continue
        value = F.col(name).cast("string")
        if name in DEFAULTS:
            value = F.coalesce(K.blank_to_null(value), F.lit(DEFAULTS[name]))
        text = F.replace(text, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return rows.withColumn(out, text)


def named_language(c: Column) -> Column:
    return F.nullif(K.blank_to_null(c), F.lit("auto"))


def fill_metadata(novels: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Suggested metadata where it is not blank, else what the novel has; a blank language or
    ``auto`` counts as none on either side and falls back to the guess from the text of the suggestion row."""
    s = suggestions.select(
        "novel_id", *[K.blank_to_null(F.col(c)).alias(f"_{c}") for c in ("title", "author", "genre", "description")],
        named_language(F.col("source_language")).alias("_lang"), detect_language(F.col("sample")).alias("_guess"))
    j = novels.join(s, "novel_id", "left")
    return j.select(
        "novel_id", *[F.coalesce(f"_{c}", c).alias(c) for c in ("title", "author", "genre", "description")],
        F.coalesce("_lang", named_language(F.col("source_language")), "_guess").alias("source_language"))


def redact_secrets(c: Column) -> Column:
    """Key-shaped words and bearer tokens out of a log message; white space collapsed."""
    t = K.squeeze_ws(F.regexp_replace(c, API_KEY, "[redacted_api_key]"))
    t = F.regexp_replace(t, r"(?i)(?<![^ ])(bearer) [^ ]+", "$1 [redacted_token]")
    return F.coalesce(F.nullif(t, F.lit("")), F.lit(NO_MESSAGE))


def novel_context(title: str = "title", author: str = "author", language: str = "source_language", genre: str = "genre", description: str = "description") -> Column:
    """Metadata block of a novel."""
    cols = [F.coalesce(K.trim_ws(F.col(c)), F.lit("")) for c in (title, author, language, genre, description)]
    return F.format_string(
        "Current novel metadata:\n- Title: %s\n- Author: %s\n- Source language: %s\n- Genre: %s\n- Description: %s", *cols)
