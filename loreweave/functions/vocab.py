"""Closed vocabularies (fixed values) and the expressions that map onto them."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loreweave.functions.keys import ascii_key, blank_to_null, folded_key

# --- Fixed values -------------------------------------------------------------------------
UNSTABLE = (
    "pronoun", "personal_pronoun", "dai_tu", "dai_tu_nhan_xung", "temporary_reference",
    "grammatical_reference", "descriptive_phrase", "event_phrase", "group_reference",
    "possessive_phrase", "generic_reference", "unstable_reference",
)
ALIAS_TYPES = {
    "nickname": ("nickname", "biet_danh", "stable_nickname"),
    "title_or_role": ("title_or_role", "title", "role", "danh_xung", "chuc_vu", "vai_tro"),
    "relationship_name": ("relationship_name", "relationship", "relation", "family_relation"),
    "unstable_reference": UNSTABLE,
}
ALIAS_LABELS = {
    "nickname": "Biệt danh",
    "title_or_role": "Danh xưng",
    "unstable_reference": "Tham chiếu tạm thời",
}
DEFAULT_ALIAS_LABEL = "Tên gọi khác"
STORED_ALIAS_TYPES = {
    "nickname": ("nickname", "biet_danh"),
    "alias": ("alias", "aliases"),
    "other_name": ("other_name", "other_names", "ten_goi_khac", "ten_khac"),
    "other_alias": ("other_alias",),
    "unstable_reference": UNSTABLE,
}
STORED_PERSISTABLE = ("alias", "aliases", "other_alias", "other_name", "other_names", "nickname")
MENTION_KINDS = ("person", "character", "nhan_vat", "nhanvat")
RELATION_SCOPES = ("kinship", "organization_hierarchy", "stable_relationship")
APPEARANCE_CLASSES = ("physical_appearance", "clothing", "age_or_build", "appearance")
# ------------------------------------------------------------------------------------------


def lookup(key: Column, table: dict[str, tuple[str, ...]], default: Column) -> Column:
    """Target of each spelling; one look into a constant map, so ``key`` is evaluated once."""
    pairs = [F.lit(x) for target, spellings in table.items() for spelling in spellings for x in (spelling, target)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), default)


def alias_type(c: Column) -> Column:
    """The alias type; whatever is unknown counts as another alias."""
    return lookup(ascii_key(c), ALIAS_TYPES, F.lit("other_alias"))


def alias_type_persistable(c: Column) -> Column:
    return alias_type(c).isin("nickname", "other_alias")


def alias_label(atype: Column, label: Column) -> Column:
    by_spelling = {ALIAS_LABELS[t]: names for t, names in ALIAS_TYPES.items() if t in ALIAS_LABELS}
    return F.coalesce(blank_to_null(label), lookup(ascii_key(atype), by_spelling, F.lit(DEFAULT_ALIAS_LABEL)))


def stored_alias_type(c: Column) -> Column:
    """C11: the alias type as the alias map stores it; unknown keys stay as they are."""
    k = folded_key(c)
    return lookup(k, STORED_ALIAS_TYPES, k)


def stored_type_persistable(c: Column) -> Column:
    return stored_alias_type(c).isin(*STORED_PERSISTABLE)
