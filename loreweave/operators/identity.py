"""Entity resolution: which observed name is which known character.

Similarity is a blocked equi-join. Blocking keys are chosen so that no pair that can reach the
review score is missed, and so that common letters or words do not pair everything with everything:
* shared words: two of the longest words of each name for each number of words that the other may have (prefix filter
  for the Dice score);
* containment and edit distance: the names of a scope meet in cells of bounded size that look up runs of letters (``nearkeys``);
  for very long ones the word before the first border of the shorter name, which ends a word of the longer one, and the letters
  after it are a block, and near ones must share one of their rarest grams near its place.
"""
from __future__ import annotations

import math
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from loreweave.functions import keys as K
from loreweave.functions import vocab as V
from loreweave.functions.textfns import let
from loreweave.operators.mentions import identity_surfaces, quoted_span_array, surfaces_in_texts
from loreweave.operators.nearkeys import LONG, contained_keys, near_keys
from loreweave.session import cut_lineage, ensure_checkpoint_dir, stored

# --- Fixed values -------------------------------------------------------------------------
SAME = 1.0
AUTO_MERGE = 0.98
REVIEW_MIN = 0.70
REVIEW_GAP = 0.05
STORED_ALIAS_SCORE = 0.82
SUBSTRING_SCORE = 0.93
DICE_WEIGHT = 0.9
LEVELS = (0.84, 0.77, REVIEW_MIN)  # our choice: names are searched from level to level until E9 is decided
GRAM = 3  # our choice: letters of a gram of the candidate search
HELD = 7  # letters from which a key counts as held in another
PAIRED = 6  # our choice: words up to which names are found by pairs of words
MERGE_SCORE_MIN = 0.90
MERGE_CONFIDENCE = 0.80
IGNORE_CONFIDENCE = 0.95
CREATION_MERGE_CONFIDENCE = 0.80
REJECT_CONFIDENCE = 0.78
CREATION_LIMIT = 12
OWNERSHIP_CONFIDENCE = 0.78
REDIRECT_MIN = 0.55
MERGE_ACTIONS = {"merge_existing": ("merge_existing", "merge", "merge_into_existing"), "ignore": ("ignore", "skip")}
CREATION_ACTIONS = {"merge_existing": MERGE_ACTIONS["merge_existing"], "reject": ("reject", "ignore", "skip")}
# ------------------------------------------------------------------------------------------


def merge_action(c: Column) -> Column:
    """Action of a merge decision."""
    return V.lookup(K.ascii_key(F.coalesce(c, F.lit(""))), MERGE_ACTIONS, F.lit("create_new"))


def creation_action(c: Column) -> Column:
    """Action of a creation decision."""
    return V.lookup(K.ascii_key(F.coalesce(c, F.lit(""))), CREATION_ACTIONS, F.lit("create_new"))


def kind_allowed(c: Column, parity: bool = True) -> Column:
    """May a candidate of this kind be a character. ``parity`` refuses a blank kind."""
    ok = K.ascii_key(c).isin(*V.MENTION_KINDS)
    return ok if parity else ok | (K.trim_ws(c) == "")


def first_per_key(rows: DataFrame, scope: Sequence[str], key: Column, order: str) -> DataFrame:
    """Keep the first row of each (scope, key); partial aggregation, no window over a scope."""
    cols = [c for c in rows.columns if c not in scope]
    return (
        rows.withColumn("_k", key)
        .groupBy(*scope, "_k")
        .agg(F.min_by(F.struct(*cols), order).alias("_r"))
        .select(*scope, *[F.col(f"_r.{c}").alias(c) for c in cols])
    )


def normalize_identities(identities: DataFrame, scope: Sequence[str] = ("chunk_id",)) -> DataFrame:
    """Cleaned names, first per key; aliases are dropped. Columns: scope, ord, name."""
    named = identities.select(*scope, "ord", K.clean_surface(F.col("name")).alias("name")).filter("name <> ''")
    return first_per_key(named, scope, K.text_key(F.col("name")), "ord")


def normalize_candidates(candidates: DataFrame, scope: Sequence[str] = ("chunk_id",), parity: bool = True) -> DataFrame:
    """Allowed candidates as identities; the shown name, else the surface."""
    name = F.coalesce(K.blank_to_null(F.col("display_name")), K.blank_to_null(F.col("surface_text")), F.lit(""))
    return normalize_identities(
        candidates.filter(kind_allowed(F.coalesce("kind", F.lit("")), parity)).select(*scope, "ord", name.alias("name")), scope
    )


def merge_hints(identities: DataFrame, hints: DataFrame, scope: Sequence[str] = ("chunk_id",)) -> DataFrame:
    """Append hints whose key no identity has; the first of equal hints."""
    h = hints.select(*scope, "ord", K.clean_surface(F.col("name")).alias("name")).withColumn("_k", K.text_key(F.col("name")))
    known = identities.select(*scope, K.text_key(F.col("name")).alias("_k")).distinct()
    new = first_per_key(
        h.filter("_k <> ''").join(known, [*scope, "_k"], "left_anti").drop("_k"), scope, K.text_key(F.col("name")), "ord"
    )
    return identities.select(*scope, "ord", "name", F.lit(False).alias("from_hint")).unionByName(
        new.withColumn("from_hint", F.lit(True))
    )


def alias_is_valid(text: Column, atype: Column, name: Column, quotes: Column) -> Column:
    """May ``text`` become an alias of ``name``. ``quotes`` are its evidence quotes."""

    def rule(x: Column) -> Column:
        clean, key = x["clean"], x["key"]
        folded, canonical = K.folded_key(clean), K.folded_key(x["name"])
        inside = (folded != "") & (canonical != "") & F.contains(folded, canonical)
        quoted = (key != "") & F.exists(
            x["quotes"],
            lambda q: F.exists(quoted_span_array(q), lambda s: K.text_key(K.clean_surface(s["text"])) == key),
        )
        return (
            (clean != "") & (key != K.text_key(x["name"])) & K.stable_alias_in_text(K.trim_ws(x["raw"]), clean)
            & V.alias_type_persistable(x["type"]) & ~inside & (K.has_upper_token(clean) | quoted)
        )

    clean = let(K.clean_surface(text), lambda c: F.struct(c.alias("c"), K.text_key(c).alias("k")))
    return let(
        let(
            clean,
            lambda c: F.struct(
                c["c"].alias("clean"), c["k"].alias("key"), text.alias("raw"), atype.alias("type"), name.alias("name"),
                F.filter(F.coalesce(quotes, F.array().cast("array<string>")), lambda q: q.isNotNull()).alias("quotes"),
            ),
        ),
        rule,
    )


def push_alias(aliases: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Valid aliases of each identity, one per key. ``aliases``: keys, name, ord, text, alias_type,
    alias_label, is_primary, quotes."""
    ok = aliases.filter(alias_is_valid(F.col("text"), F.col("alias_type"), F.col("name"), F.col("quotes")))
    ok = ok.withColumn("text", K.clean_surface(F.col("text"))).withColumn("_k", K.text_key(F.col("text")))
    has = F.size(F.coalesce("quotes", F.array().cast("array<string>"))) > 0
    first = F.min_by(
        F.struct("name", "text", V.alias_type(F.col("alias_type")).alias("alias_type"),
                 V.alias_label(F.col("alias_type"), F.col("alias_label")).alias("alias_label")), "ord")
    return (
        ok.groupBy(*keys, "_k")
        .agg(
            first.alias("_f"), F.bool_or("is_primary").alias("is_primary"), F.min("ord").alias("ord"),
            F.min_by(F.when(has, F.col("quotes")), F.when(has, F.col("ord"))).alias("quotes"),
        )
        .select(*keys, "_f.*", "is_primary", "ord", F.coalesce("quotes", F.array().cast("array<string>")).alias("quotes"))
    )


def alias_map_candidates(aliases: DataFrame, scope: Sequence[str] = ("novel_id",)) -> DataFrame:
    """E5: one candidate per entity of the alias map: canonical name, valid aliases, first chapter.

    ``aliases`` is the alias map in its listed order (column ``ord``)."""
    a = aliases.withColumn("target_key", K.trim_ws(F.col("entity_key"))).filter("target_key <> ''")
    canonical = F.col("alias_type") == "canonical_name"
    heads = a.groupBy(*scope, "target_key").agg(
        F.coalesce(F.max_by(F.when(canonical, F.col("alias_text")), F.when(canonical, F.col("ord"))), F.min_by("display_name", "ord")).alias("display_name"),
        F.min("first_chapter_num").alias("chapter_num"),
    )
    pushed = push_alias(
        a.filter(~canonical).join(heads.drop("chapter_num"), [*scope, "target_key"]).select(
            *scope, "target_key", heads["display_name"].alias("name"), "ord", F.col("alias_text").alias("text"), "alias_type",
            "alias_label", (F.coalesce("confidence", F.lit(0.0)) >= 1.0).alias("is_primary"), "quotes",
        ),
        [*scope, "target_key"],
    )
    lists = pushed.groupBy(*scope, "target_key").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]).alias("aliases")
    )
    return heads.join(lists, [*scope, "target_key"], "left").withColumn(
        "aliases", F.coalesce("aliases", F.array().cast("array<string>"))
    )


# --- E6: similarity ---------------------------------------------------------------------------


def strong_key(k: Column) -> Column:
    chars = F.length(F.translate(k, "_", ""))
    return (chars >= 4) & ((F.size(F.split(k, "_")) >= 2) | (chars >= 6))


def resolution_surfaces(identities: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Strong folded keys of name and aliases: keys, skey, canonical."""
    s = F.concat(
        F.array(F.struct(F.col("name").alias("t"), F.lit(True).alias("c"))),
        F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.struct(a.alias("t"), F.lit(False).alias("c"))),
    )
    keyed = F.transform(s, lambda x: F.struct(K.folded_key(K.clean_surface(x["t"])).alias("k"), x["c"].alias("c")))
    return (
        identities.select(*keys, F.explode(F.filter(keyed, lambda x: strong_key(x["k"]))).alias("_s"))
        .groupBy(*keys, F.col("_s.k").alias("skey"))
        .agg(F.bool_or("_s.c").alias("canonical"))
    )


def _limit_of(n: Column, minimum: float = REVIEW_MIN) -> Column:
    """Largest edit distance that still reaches ``minimum`` for the longer length ``n``."""
    return F.floor(n * (1 - minimum) + 1e-9).cast("int")


def _grams(k: Column) -> Column:
    """Runs of ``GRAM`` letters of a key padded at both ends -> array of (gram, at)."""
    pad = GRAM - 1
    padded = F.concat(F.lit("^" * pad), k, F.lit("$" * pad))
    return F.transform(
        F.sequence(F.lit(1), F.length(k) + pad), lambda i: F.struct(F.substring(padded, i, F.lit(GRAM)).alias("gram"), i.alias("at"))
    )


def _rare_grams(keys: DataFrame) -> DataFrame:
    """(skey, rare): the grams of each distinct key at which a key within the edit limit must be met, with places.

    Two keys within d edits share all but GRAM * d grams of the longer one, each at a place that differs by d at most.
    In an order common to all keys the first of these stands among the first grams of both; the order is by rarity, so
    a word that very many names carry is hardly ever among them. How many are needed depends on the longer key."""
    grams = keys.select("skey").distinct().select("skey", F.explode(_grams(F.col("skey"))).alias("_g")).select("skey", "_g.gram", "_g.at")
    counts = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    n = F.length("skey")
    need = F.array_max(F.transform(
        F.sequence(n, F.floor(n / REVIEW_MIN + 1e-9).cast("int")), lambda longer: n - longer + GRAM * _limit_of(longer) + 1
    ))
    ranked = grams.join(counts.hint("merge"), "gram").groupBy("skey").agg(F.array_sort(F.collect_list(F.struct("n", "gram", "at"))).alias("_all"))
    return ranked.select("skey", F.slice("_all", F.lit(1), need).alias("rare"))


def _near_long(left: DataFrame, right: DataFrame, scope: Sequence[str], minimum: float) -> DataFrame:
    """(scope, _l, _r): what ``near_keys`` leaves out, near pairs in which a key has more than ``LONG`` letters. They share a
    rare gram at places that differ by the distance at most."""
    ls, rs = (df.filter(F.length("skey") > int(LONG * REVIEW_MIN)) for df in (left, right))
    rare = _rare_grams(ls.select("skey").unionByName(rs.select("skey")))

    def rows(keys: DataFrame, out: str) -> DataFrame:
        return keys.join(rare.hint("merge"), "skey").select(*scope, F.col("skey").alias(out), F.explode("rare").alias("_g")).select(
            *scope, out, "_g.gram", F.col("_g.at").alias(out + "_at"))

    l, r = F.col("_l"), F.col("_r")
    longer = F.greatest(F.length(l), F.length(r))
    most = _limit_of(longer, minimum)
    return (
        rows(ls, "_l").join(rows(rs, "_r").hint("merge"), [*scope, "gram"])
        .filter((longer > LONG) & (F.abs(F.col("_l_at") - F.col("_r_at")) <= most) & (F.abs(F.length(l) - F.length(r)) <= most))
        .select(*scope, "_l", "_r").distinct()
        .filter(F.levenshtein(l, r) <= most)
    )


def _nearly_equal(left: DataFrame, right: DataFrame, scope: Sequence[str], minimum: float) -> DataFrame:
    """(scope, _l, _r): pairs of a score that neither shared words nor containment reach. Equal keys meet by equality; only
    keys so long that the score allows an edit are searched for near ones."""
    skey = F.col("skey")
    same = left.join(right, [*scope, "skey"]).select(*scope, skey.alias("_l"), skey.alias("_r"))
    if minimum >= 1:
        return same
    longer = math.ceil((1 - 1e-9) / (1 - minimum))  # letters from which on one edit is allowed
    left, right = (df.filter(F.length("skey") >= int(longer * minimum)) for df in (left, right))
    return same.unionByName(near_keys(left, right, scope, minimum)).unionByName(_near_long(left, right, scope, minimum))


def _dice(a: Column, b: Column) -> Column:
    """Dice score of the distinct words of two keys."""
    ta, tb = F.array_distinct(F.split(a, "_")), F.array_distinct(F.split(b, "_"))
    return F.lit(2.0) * F.size(F.array_intersect(ta, tb)) / (F.size(ta) + F.size(tb))


def _contained(a: Column, b: Column) -> Column:
    """One key lies in the other, both of several words and not too short."""
    return (
        (F.least(F.length(a), F.length(b)) >= HELD) & (F.size(F.split(a, "_")) >= 2) & (F.size(F.split(b, "_")) >= 2)
        & (F.contains(a, b) | F.contains(b, a))
    )


def _word_blocks(k: Column) -> Column:
    """The longest words: enough of them that two names with the needed Dice score share one block.

    Names of m and n words need ``t`` words in common; in an order common to all names the first two of these stand among the
    first m - t + 2 and n - t + 2, so names of few words state pairs of them for each (m, n). Names of more than
    ``PAIRED`` words, and those that can be near one, state single words."""
    words = F.transform(
        F.array_sort(F.transform(F.array_distinct(F.split(k, "_")), lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))),
        lambda w: w["t"],
    )
    r = REVIEW_MIN / DICE_WEIGHT

    def needed(m: int, n: int) -> int:
        return math.ceil(r * (m + n) / 2 - 1e-9)

    def paired(m: int) -> list[Column]:
        return [
            F.concat(F.lit(f"w{min(m, n)},{max(m, n)}|"), F.get(words, F.lit(i)), F.lit("|"), F.get(words, F.lit(j)))
            for n in range(2, PAIRED + 1) if needed(m, n) <= min(m, n)
            for j in range(1, m - needed(m, n) + 2) for i in range(j)
        ]

    # Dice >= r needs at least r / (2 - r) of the words of either side
    need = F.ceil(F.size(words) * (r / (2 - r)) - 1e-9).cast("int")
    single = F.transform(F.slice(words, F.lit(1), F.size(words) - need + 1), lambda w: F.concat(F.lit("w|"), w))
    out, none = F.when(F.size(words) > PAIRED, single), F.array().cast("array<string>")
    for m in range(2, PAIRED + 1):
        far = m * (2 - r) / r + 1e-9 >= PAIRED + 1
        out = out.when(F.size(words) == m, F.concat(F.array(*paired(m)), single if far else none))
    return out.otherwise(none)  # one word alone has the score only with itself, which is no edit away


def _border_blocks(k: Column, role: str, longer: bool) -> Column:
    """The shorter name states its first word and up to three letters after it; the longer one states, at every border,
    every end of the word before and every width after."""
    words = F.split(k, "_")
    many, none = F.size(words) >= 2, F.array().cast("array<string>")

    def block(before: Column, after: Column) -> Column:
        return F.concat(F.lit(role + "|"), before, F.lit("_"), after)

    if not longer:
        return F.when(many, F.array(block(F.get(words, F.lit(0)), F.left(F.get(words, F.lit(1)), F.lit(3))))).otherwise(none)
    three = F.array(*[F.lit(i) for i in (1, 2, 3)])
    ends = lambda w: F.sequence(F.lit(0), F.length(w))
    return F.when(many, F.array_distinct(F.flatten(F.transform(
        F.sequence(F.lit(0), F.size(words) - 2),
        lambda i: F.flatten(F.transform(ends(F.get(words, i)), lambda x: F.transform(
            three, lambda y: block(F.right(F.get(words, i), x), F.left(F.get(words, i + 1), y))
        ))),
    )))).otherwise(none)


def _block_rows(keys: DataFrame, scope: Sequence[str], side: str, out: str) -> DataFrame:
    """One row per distinct key and blocking key; the blocking key travels as a hash (pairs that only
    share a hash are dropped by the comparison). Only keys that ``contained_keys`` leaves out are looked into for others."""
    k, left = F.col("skey"), side == "left"
    within = F.when(F.length(k) > LONG, _border_blocks(k, "c2" if left else "c1", True)).otherwise(F.array().cast("array<string>"))
    blocks = F.array_distinct(F.concat(_word_blocks(k), _border_blocks(k, "c1" if left else "c2", False), within))
    rows = keys.select(*scope, k.alias(out), F.explode(blocks).alias("_x"))
    return rows.select(*scope, out, F.left("_x", F.lit(1)).alias("_kind"), F.xxhash64("_x").alias("_b"))


def surface_similarity(a: Column, b: Column) -> Column:
    """Similarity of two strong folded keys."""
    longest = F.greatest(F.length(a), F.length(b))
    edit = F.lit(1.0) - F.levenshtein(a, b) / longest
    return F.when(a == b, F.lit(1.0)).otherwise(
        F.greatest(edit, _dice(a, b) * DICE_WEIGHT, F.when(_contained(a, b), F.lit(SUBSTRING_SCORE)).otherwise(F.lit(0.0)))
    )


def capped(similarity: Column, a_canonical: Column, b_canonical: Column) -> Column:
    """Score of two surfaces of this similarity; an observed name against a stored alias is capped."""
    return F.when(a_canonical & ~b_canonical, F.least(similarity, F.lit(STORED_ALIAS_SCORE))).otherwise(similarity)


def pair_score(a: Column, a_canonical: Column, b: Column, b_canonical: Column) -> Column:
    """Score of two surfaces."""
    return capped(surface_similarity(a, b), a_canonical, b_canonical)


def identity_scores(
    left: DataFrame, right: DataFrame, scope: Sequence[str] = ("novel_id",), left_id: str = "left_id",
    right_id: str = "right_id", minimum: float = REVIEW_MIN,
) -> DataFrame:
    """Best score of each (left, right) pair that reaches ``minimum`` (at least the review score).

    Blocking works on distinct keys, so copies of one name are compared once."""
    if minimum < REVIEW_MIN:
        raise ValueError("blocking is complete only from the review score upwards")
    ls, rs = _both_surfaces(left, right, scope, left_id, right_id)
    lk, rk = (s.select(*scope, "skey").distinct() for s in (ls, rs))
    if minimum > max(DICE_WEIGHT, SUBSTRING_SCORE):
        met = _nearly_equal(lk, rk, scope, minimum)
    else:
        met = _met_by_words(lk, rk, scope, minimum).unionByName(_near(lk, rk, scope, minimum))
    return _best_scores(_similar(met, minimum), ls, rs, scope, left_id, right_id, minimum)


def _both_surfaces(left: DataFrame, right: DataFrame, scope: Sequence[str], left_id: str, right_id: str) -> list[DataFrame]:
    """Both are read by every block and again for the ids: written once, on reliable storage."""
    return [stored(resolution_surfaces(df, [*scope, i]), "surfaces") for df, i in ((left, left_id), (right, right_id))]


def _met_by_words(lk: DataFrame, rk: DataFrame, scope: Sequence[str], minimum: float) -> DataFrame:
    """(scope, _l, _r): keys that reach ``minimum`` by shared words or by containment, some more than once."""
    l, r = F.col("_l"), F.col("_r")
    # the planner takes the blocks to be as few as the names and would broadcast them
    met = _block_rows(lk, scope, "left", "_l").join(_block_rows(rk, scope, "right", "_r").hint("merge"), [*scope, "_kind", "_b"]).filter(
        F.when(F.col("_kind") == "w", _dice(l, r) * DICE_WEIGHT >= minimum).otherwise(_contained(l, r))
    ).select(*scope, "_l", "_r")
    lw, rw = (df.filter((F.length("skey") >= HELD) & F.contains("skey", F.lit("_"))) for df in (lk, rk))
    return met.unionByName(contained_keys(lw, rw, scope, HELD))


def _near(lk: DataFrame, rk: DataFrame, scope: Sequence[str], minimum: float) -> DataFrame:
    return near_keys(lk, rk, scope, minimum).unionByName(_near_long(lk, rk, scope, minimum))


def _similar(met: DataFrame, minimum: float) -> DataFrame:
    """Compared once per pair of keys, not once per pair of names that carry them."""
    return met.distinct().withColumn("_s", surface_similarity(F.col("_l"), F.col("_r"))).filter(F.col("_s") >= minimum)


def _best_scores(
    pairs: DataFrame, ls: DataFrame, rs: DataFrame, scope: Sequence[str], left_id: str, right_id: str, minimum: float,
) -> DataFrame:
    hit = pairs.join(
        ls.select(*scope, left_id, F.col("skey").alias("_l"), F.col("canonical").alias("_lc")).hint("merge"), [*scope, "_l"]
    ).join(rs.select(*scope, right_id, F.col("skey").alias("_r"), F.col("canonical").alias("_rc")).hint("merge"), [*scope, "_r"])
    score = capped(F.col("_s"), F.col("_lc"), F.col("_rc"))
    return (
        hit.groupBy(*scope, left_id, right_id).agg(F.max(score).alias("score")).filter(F.col("score") >= minimum)
    )


# --- the ladder -------------------------------------------------------------------------------
# observed:   scope, observed_id, name, aliases (array of text)
# candidates: scope, source (alias_map | stored | working), cand_id, target_key, display_name, aliases,
#             chapter_num, ord (order within its source)
STEPS = {"stored": 1, "working": 2, "alias_map": 3}
HIGH_STEPS = {"alias_map": 4, "stored": 5, "working": 6}


def score_candidates(
    observed: DataFrame, candidates: DataFrame, scope: Sequence[str] = ("novel_id",), minimum: float = REVIEW_MIN,
) -> DataFrame:
    """Scores (from ``minimum`` upwards) of observed identities against all candidates."""
    return _told(identity_scores(observed, _as_right(candidates, scope), scope, "observed_id", "cand_id", minimum), candidates, scope)


def _as_right(candidates: DataFrame, scope: Sequence[str]) -> DataFrame:
    return candidates.select(*scope, "cand_id", F.col("display_name").alias("name"), "aliases")


def _told(scores: DataFrame, candidates: DataFrame, scope: Sequence[str]) -> DataFrame:
    return scores.join(candidates.select(*scope, "cand_id", "source", "target_key", "display_name", "chapter_num", "ord"), [*scope, "cand_id"])


def true_scores(pairs: DataFrame, observed: DataFrame, candidates: DataFrame, scope: Sequence[str] = ("novel_id",)) -> DataFrame:
    """E6 score of given pairs (scope, observed_id, cand_id), however low."""
    cand = candidates.select(*scope, "cand_id", F.col("display_name").alias("name"), "aliases")
    ls = resolution_surfaces(observed, [*scope, "observed_id"]).select(*scope, "observed_id", F.col("skey").alias("_l"), F.col("canonical").alias("_lc"))
    rs = resolution_surfaces(cand, [*scope, "cand_id"]).select(*scope, "cand_id", F.col("skey").alias("_r"), F.col("canonical").alias("_rc"))
    return (
        pairs.join(ls, [*scope, "observed_id"], "left").join(rs, [*scope, "cand_id"], "left")
        .groupBy(*scope, "observed_id", "cand_id")
        .agg(F.coalesce(F.max(pair_score(F.col("_l"), F.col("_lc"), F.col("_r"), F.col("_rc"))), F.lit(0.0)).alias("score"))
    )


def review_scores(observed: DataFrame, candidates: DataFrame, scope: Sequence[str] = ("novel_id",)) -> DataFrame:
    """The scores that E9 reads, in the columns of ``score_candidates``, of every observed name with one of the review score.

    The names are searched down from level to level of ``LEVELS``. A name leaves at the level that decides E9: its best target
    key below the automatic score has a runner-up within the gap, or whatever is not found yet lies outside the gap. Then
    the lower scores of the best target key, which E9 pools, are the only ones still looked up. Of such a name only the rows
    that decide are returned."""
    keys = [*scope, "observed_id"]
    key = F.struct("target_key").alias("_key")  # a missing key is one too
    several = candidates.groupBy(*scope, key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    ls, rs = _both_surfaces(observed, _as_right(candidates, scope), scope, "observed_id", "cand_id")
    lk, rk = (s.select(*scope, "skey").distinct() for s in (ls, rs))
    by_words = stored(_similar(_met_by_words(lk, rk, scope, REVIEW_MIN), REVIEW_MIN), "by-words")
    found = []
    for level in LEVELS:
        lk = ls.select(*scope, "skey").distinct()
        pairs = _similar(_near(lk, rk, scope, level), level).unionByName(by_words.filter(F.col("_s") >= level)).distinct()
        here = stored(_told(_best_scores(pairs, ls, rs, scope, "observed_id", "cand_id", level), candidates, scope), "scores")
        if level <= REVIEW_MIN:
            found.append(here)
            break
        pooled = here.filter(F.col("score") < AUTO_MERGE).groupBy(*keys, "target_key").agg(F.max("score").alias("score"))
        best = pooled.groupBy(*keys).agg(F.max_by(key, "score").alias("_key"), F.slice(F.sort_array(F.collect_list("score"), False), 1, 2).alias("_s"))
        first, second = F.get("_s", F.lit(0)), F.get("_s", F.lit(1))
        close = first - second < REVIEW_GAP
        decided = stored(best.select(*keys, "_key", (~F.coalesce(close, F.lit(False))).alias("_alone"), first.alias("_first"), second.alias("_second")).filter(
            ~F.col("_alone") | (F.col("_first") - level >= REVIEW_GAP)).drop("_first"), "decided")
        # of the rows of a level, those of the best target key, or of the runner-up and above where that is within the gap
        rows = here.join(decided, keys).filter(
            F.when(F.col("_alone"), F.struct("target_key") == F.col("_key")).otherwise((F.col("score") >= F.col("_second")) & (F.col("score") < AUTO_MERGE))
        ).select(*here.columns)
        pool = decided.filter("_alone").drop("_alone", "_second").join(several, [*scope, "_key"], "left_semi")
        lower = true_scores(
            pool.join(candidates.select(*scope, key, "cand_id"), [*scope, "_key"]).select(*keys, "cand_id")
            .join(rows.select(*keys, "cand_id"), [*keys, "cand_id"], "left_anti"), observed, candidates, scope,
        ).filter(F.col("score") >= REVIEW_MIN)
        found += [rows, _told(lower, candidates, scope).select(*here.columns)]
        ls = stored(ls.join(decided.select(*keys), keys, "left_anti"), "surfaces")
    return reduce(DataFrame.unionByName, found)


def scored_identities(observed: DataFrame, candidates: DataFrame, scope: Sequence[str] = ("novel_id",)) -> DataFrame:
    """(scope, observed_id): the observed with a candidate of the review score or more. Most have one with an equal key; only
    the others are searched for near ones."""
    keys = [*scope, "observed_id"]
    right = candidates.select(*scope, "cand_id", F.col("display_name").alias("name"), "aliases")
    same = cut_lineage(identity_scores(observed, right, scope, "observed_id", "cand_id", SAME).select(*keys).distinct())
    rest = observed.join(same, keys, "left_anti")
    return same.unionByName(identity_scores(rest, right, scope, "observed_id", "cand_id").select(*keys).distinct())


def _step(source: Column, table: dict[str, int]) -> Column:
    out = None
    for name, step in table.items():
        out = (F if out is None else out).when(source == name, F.lit(step))
    return out


def exact_match(observed: DataFrame, candidates: DataFrame, scores: DataFrame, scope: Sequence[str] = ("novel_id",)) -> DataFrame:
    """Steps 1-3. Stored, then working record of the same name; else the one alias-map entity
    with score ``SAME``; lower ones are not read."""
    o = observed.select(*scope, "observed_id", K.text_key(F.col("name")).alias("_k"))
    c = candidates.filter(F.col("source") != "alias_map").select(*scope, K.text_key(F.col("display_name")).alias("_k"), "source", "cand_id", "ord")
    named = o.join(c, [*scope, "_k"]).select(*scope, "observed_id", _step(F.col("source"), STEPS).alias("step"), "ord", "cand_id")
    mapped = (
        scores.filter((F.col("source") == "alias_map") & (F.col("score") >= SAME))
        .groupBy(*scope, "observed_id")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("ord").alias("ord"), F.min_by("cand_id", "ord").alias("cand_id"))
        .filter("_n = 1")
        .select(*scope, "observed_id", F.lit(3).alias("step"), "ord", "cand_id")
    )
    return (
        named.unionByName(mapped).groupBy(*scope, "observed_id")
        .agg(F.min(F.struct("step", "ord", "cand_id")).alias("_m"))
        .select(*scope, "observed_id", "_m.step", "_m.cand_id")
    )


def high_confidence_match(scores: DataFrame, scope: Sequence[str] = ("novel_id",)) -> DataFrame:
    """Steps 4-6. A unique best score of at least ``AUTO_MERGE`` within one source; lower ones are not read."""
    best = (
        scores.filter(F.col("score") >= AUTO_MERGE)
        .groupBy(*scope, "observed_id", "source", "score")
        .agg(F.count(F.lit(1)).alias("_n"), F.min_by("cand_id", "ord").alias("cand_id"))
        .groupBy(*scope, "observed_id", "source")
        .agg(F.max_by(F.struct("_n", "cand_id"), "score").alias("_t"))
        .filter("_t._n = 1")
        .select(*scope, "observed_id", _step(F.col("source"), HIGH_STEPS).alias("step"), F.col("_t.cand_id").alias("cand_id"))
    )
    return best.groupBy(*scope, "observed_id").agg(F.min(F.struct("step", "cand_id")).alias("_m")).select(
        *scope, "observed_id", "_m.step", "_m.cand_id"
    )


def _pooled(rows: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Candidates of one target key pooled: best score, first chapter, first name in source order."""
    order = F.struct(_step(F.col("source"), HIGH_STEPS), "ord")
    return rows.groupBy(*scope, "observed_id", "target_key").agg(
        F.max("score").alias("score"), F.min("chapter_num").alias("chapter_num"),
        F.min_by("display_name", order).alias("display_name"), F.min_by("cand_id", order).alias("cand_id"),
    )


def merge_review_candidate(scores: DataFrame, scope: Sequence[str] = ("novel_id",)) -> DataFrame:
    """Step 7. Best candidate below the automatic score, unless the runner-up is within the gap."""
    pooled = _pooled(scores.filter((F.col("score") >= REVIEW_MIN) & (F.col("score") < AUTO_MERGE)), scope)
    w = Window.partitionBy(*scope, "observed_id").orderBy(F.desc("score"), "display_name", "target_key")
    return (
        pooled.withColumn("_rn", F.row_number().over(w)).withColumn("_next", F.lead("score").over(w))
        .filter((F.col("_rn") == 1) & (F.col("_next").isNull() | (F.col("score") - F.col("_next") >= REVIEW_GAP)))
        .drop("_rn", "_next")
    )


def word_edges(c: Column) -> Column:
    """Proper prefixes and suffixes of a key that end or start at a word border."""
    words = F.split(c, "_")
    n = F.size(words)
    parts = F.flatten(F.transform(
        F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
        lambda i: F.array(F.array_join(F.slice(words, F.lit(1), i), "_"), F.array_join(F.slice(words, i + 1, n), "_")),
    ))
    return F.when(n > 1, F.array_distinct(parts)).otherwise(F.array().cast("array<string>"))


def creation_review_candidates(
    observed: DataFrame, candidates: DataFrame, scores: DataFrame, texts: DataFrame,
    scope: Sequence[str] = ("novel_id",), limit: int | None = None,
) -> DataFrame:
    """Step 8. Similar candidates, candidates named in the text of the observation, and candidates
    whose name starts or ends the observed name; pooled and ranked. ``limit`` keeps the best only (the
    original asks about CREATION_LIMIT).

    ``texts``: scope, text_id, text; ``observed`` needs text_id."""
    close = scores.select(*scope, "observed_id", "cand_id", "score")
    feed = _named_candidates(observed, candidates, texts, scope).join(close, [*scope, "observed_id", "cand_id"], "full")
    # a candidate below the blocked score still needs its true score
    low = true_scores(feed.filter("score IS NULL").drop("score"), observed, candidates, scope)
    ranked = _ranked(feed.filter("score IS NOT NULL").unionByName(low), candidates, scope)
    return ranked if limit is None else ranked.filter(F.col("rank") <= limit)


def _surfaces(candidates: DataFrame, scope: Sequence[str]) -> DataFrame:
    cand = candidates.select(*scope, "cand_id", F.col("display_name").alias("name"), "aliases")
    return identity_surfaces(cand, (*scope, "cand_id")).select(*scope, "cand_id", "surface")


def _named_candidates(observed: DataFrame, candidates: DataFrame, texts: DataFrame, scope: Sequence[str]) -> DataFrame:
    """(scope, observed_id, cand_id): candidates named in the text of the observation, and those whose name starts or ends
    the observed name."""
    surfaces = _surfaces(candidates, scope)
    read = texts.join(observed.select("text_id", *scope).distinct(), ["text_id", *scope], "left_semi")
    in_text = surfaces_in_texts(read, surfaces, list(scope))
    seen = observed.select(*scope, "observed_id", "text_id").join(in_text, ["text_id", *scope]).join(surfaces, [*scope, "surface"]).select(*scope, "observed_id", "cand_id")
    edges = observed.select(*scope, "observed_id", F.explode(word_edges(K.folded_key(F.col("name")))).alias("_k"))
    parts = edges.join(
        surfaces.select(*scope, "cand_id", K.folded_key(F.col("surface")).alias("_k")).filter("_k <> ''"), [*scope, "_k"]
    ).select(*scope, "observed_id", "cand_id")
    return seen.unionByName(parts).distinct()


def _ranked(feed: DataFrame, candidates: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Scored candidates pooled by target key and ranked for each observed identity."""
    rows = feed.join(candidates.select(*scope, "cand_id", "source", "target_key", "display_name", "chapter_num", "ord"), [*scope, "cand_id"])
    w = Window.partitionBy(*scope, "observed_id").orderBy(F.desc("score"), "chapter_num", "display_name", "target_key")
    return _pooled(rows, scope).withColumn("rank", F.row_number().over(w))


def creation_targets(
    observed: DataFrame, candidates: DataFrame, scored: DataFrame, texts: DataFrame, decisions: DataFrame,
    scope: Sequence[str] = ("novel_id",),
) -> tuple[DataFrame, DataFrame]:
    """What E12 reads of E10: (the rows that a decision can name, in the order of their ranks; the observed with any row).

    A decision names its target by key or by name, so only candidates of such target keys are scored and looked for in the
    text. ``scored``: the observed with a candidate of the review score or more (``scored_identities``)."""
    keys = [*scope, "observed_id"]
    d = _creation_told(decisions, scope).join(observed.select(*keys), keys, "left_semi")
    names = F.concat(F.array("display_name"), F.coalesce("aliases", F.array().cast("array<string>")))
    by_key = candidates.select(*scope, "target_key", K.ascii_key(F.col("target_key")).alias("_tk")).distinct()
    by_name = candidates.select(*scope, "target_key", F.explode(F.transform(names, K.text_key)).alias("_tn")).filter("_tn <> ''").distinct()
    named = d.join(by_key, [*scope, "_tk"]).select(*keys, "target_key").unionByName(d.join(by_name, [*scope, "_tn"]).select(*keys, "target_key"))
    pairs = named.distinct().join(candidates.select(*scope, "target_key", "cand_id"), [*scope, "target_key"]).select(*keys, "cand_id")
    rated = stored(true_scores(pairs, observed, candidates, scope), "rated")
    # below the review score a candidate counts if the text names it, or if its name starts or ends the observed one
    at = rated.filter(F.col("score") < REVIEW_MIN).join(
        observed.select(*keys, "text_id", word_edges(K.folded_key(F.col("name"))).alias("_edges")), keys
    ).join(_surfaces(candidates, scope), [*scope, "cand_id"])
    lists = at.select(*scope, "text_id", "surface").distinct()
    read = texts.join(lists.select(*scope, "text_id").distinct(), [*scope, "text_id"], "left_semi")
    seen = at.join(surfaces_in_texts(read, lists, [*scope, "text_id"]), [*scope, "text_id", "surface"], "left_semi")
    part = F.array_contains("_edges", K.folded_key(F.col("surface"))) & (K.folded_key(F.col("surface")) != "")
    low = seen.select(*keys, "cand_id").unionByName(at.filter(part).select(*keys, "cand_id")).distinct()
    feed = rated.filter(F.col("score") >= REVIEW_MIN).unionByName(rated.join(low, [*keys, "cand_id"], "left_semi"))
    bare = observed.join(scored.select(*keys), keys, "left_anti")
    asked = scored.join(observed.select(*keys), keys, "left_semi").select(*keys).unionByName(
        _named_candidates(bare, candidates, texts, scope).select(*keys).distinct())
    return _ranked(feed, candidates, scope), asked


def known_name_phrase(observed: DataFrame, known: DataFrame, scope: Sequence[str] = ("novel_id",)) -> DataFrame:
    """Observed identities whose name starts or ends with a known name at a word border."""
    k = known.select(*scope, K.folded_key(F.col("display_name")).alias("_k")).filter("_k <> ''").distinct()
    edges = observed.select(*scope, "observed_id", F.explode(word_edges(K.folded_key(F.col("name")))).alias("_k"))
    return edges.join(k, [*scope, "_k"], "left_semi").select(*scope, "observed_id").distinct()


def apply_merge_decisions(
    best: DataFrame, decisions: DataFrame, phrases: DataFrame, scope: Sequence[str] = ("novel_id",)
) -> DataFrame:
    """Outcome of step 7. ``decisions``: scope, observed_id, action, confidence."""
    d = best.join(decisions.select(*scope, "observed_id", "action", "confidence"), [*scope, "observed_id"], "left")
    d = d.join(phrases.select(*scope, "observed_id", F.lit(True).alias("_phrase")), [*scope, "observed_id"], "left")
    act, conf = merge_action(F.col("action")), F.coalesce("confidence", F.lit(0.0))
    applied = (
        F.when((act == "merge_existing") & (F.col("score") >= MERGE_SCORE_MIN) & (conf >= MERGE_CONFIDENCE), F.lit("merge_existing"))
        .when((act == "ignore") & (conf >= IGNORE_CONFIDENCE), F.lit("ignore"))
        .when((act == "create_new") & F.col("_phrase").isNotNull(), F.lit("ignore_known_name_phrase"))
        .otherwise(F.lit("create_new"))
    )
    return d.select(*scope, "observed_id", F.lit(7).alias("step"), applied.alias("applied"),
                    F.when(applied == "merge_existing", F.col("cand_id")).alias("cand_id"), "score")


def _creation_told(decisions: DataFrame, scope: Sequence[str]) -> DataFrame:
    return decisions.select(
        *scope, "observed_id", creation_action(F.col("action")).alias("_act"), F.coalesce("confidence", F.lit(0.0)).alias("_conf"),
        F.when(F.col("target_key").isNotNull(), K.ascii_key(F.col("target_key"))).alias("_tk"),
        K.text_key(F.coalesce("target_name", F.lit(""))).alias("_tn"),
    )


def apply_creation_decisions(
    reviewed: DataFrame, candidates: DataFrame, decisions: DataFrame, phrases: DataFrame, scope: Sequence[str] = ("novel_id",),
    asked: DataFrame | None = None,
) -> DataFrame:
    """Outcome of step 8. ``decisions``: scope, observed_id, action, confidence, target_key,
    target_name. The target is found by key, else by name or alias, among the reviewed candidates. ``asked``: the observed
    with any candidate, where ``reviewed`` holds only those that a decision can name (``creation_targets``)."""
    keys = [*scope, "observed_id"]
    d = _creation_told(decisions, scope)
    r = reviewed.join(candidates.select(*scope, "cand_id", "aliases"), [*scope, "cand_id"]).join(d, keys)
    names = F.concat(F.array("display_name"), F.coalesce("aliases", F.array().cast("array<string>")))
    by_key = K.ascii_key(F.col("target_key")) == F.col("_tk")
    by_name = (F.col("_tn") != "") & F.exists(names, lambda n: K.text_key(n) == F.col("_tn"))
    target = r.groupBy(*keys).agg(
        F.coalesce(F.min_by("cand_id", F.when(by_key, F.col("rank"))), F.min_by("cand_id", F.when(by_name, F.col("rank")))).alias("_target")
    )
    base = (reviewed if asked is None else asked).select(*keys).distinct().join(d, keys, "left").join(target, keys, "left").join(
        phrases.select(*keys, F.lit(True).alias("_phrase")), keys, "left"
    )
    act, conf = F.coalesce("_act", F.lit("create_new")), F.coalesce("_conf", F.lit(0.0))
    applied = (
        F.when((act == "merge_existing") & (conf >= CREATION_MERGE_CONFIDENCE) & F.col("_target").isNotNull(), F.lit("merge_existing"))
        .when((act == "reject") & (conf >= REJECT_CONFIDENCE), F.lit("reject"))
        .when(F.col("_phrase").isNotNull(), F.lit("reject_known_name_phrase"))
        .otherwise(F.lit("create_new"))
    )
    return base.select(*keys, F.lit(8).alias("step"), applied.alias("applied"),
                       F.when(applied == "merge_existing", F.col("_target")).alias("cand_id"))


def sanitize_new_identity(aliases: DataFrame, known: DataFrame, keys: Sequence[str], scope: Sequence[str] = ("novel_id",)) -> DataFrame:
    """Aliases a new identity may keep: valid ones that are no other known name. ``aliases`` as in
    ``push_alias``."""
    blocked = known.select(*scope, K.text_key(F.col("display_name")).alias("_t")).filter("_t <> ''").distinct()
    a = aliases.withColumn("_t", K.text_key(F.col("text"))).withColumn("_own", K.text_key(F.col("name")))
    own = a.filter(F.col("_t") == F.col("_own"))
    free = a.filter(F.col("_t") != F.col("_own")).join(blocked, [*scope, "_t"], "left_anti")
    return push_alias(free.unionByName(own).drop("_t", "_own"), keys)


def absorb_observed(matches: DataFrame, observed: DataFrame, candidates: DataFrame, known: DataFrame, scope: Sequence[str] = ("novel_id",)) -> DataFrame:
    """Aliases of each match target after it took over the observed name and aliases.

    One row per (observed, alias): the target's own aliases first, then the observed name and aliases
    that are no known name and pass the alias rule."""
    keys = [*scope, "observed_id"]
    j = matches.select(*keys, "cand_id").join(candidates.select(*scope, "cand_id", "display_name", "aliases"), [*scope, "cand_id"]).join(
        observed.select(*keys, F.col("name").alias("_name"), F.col("aliases").alias("_aliases")), keys
    )
    empty = F.array().cast("array<string>")
    parts = F.concat(
        F.transform(F.coalesce("aliases", empty), lambda a, i: F.struct(F.lit(0).alias("g"), i.alias("i"), a.alias("t"))),
        F.array(F.struct(F.lit(1).alias("g"), F.lit(0).alias("i"), F.col("_name").alias("t"))),
        F.transform(F.coalesce("_aliases", empty), lambda a, i: F.struct(F.lit(2).alias("g"), i.alias("i"), a.alias("t"))),
    )
    rows = j.select(*keys, F.col("display_name").alias("name"), F.explode(parts).alias("_p")).withColumn("_t", K.text_key(F.col("_p.t")))
    blocked = known.select(*scope, K.text_key(F.col("display_name")).alias("_t"), F.lit(True).alias("_known")).distinct()
    rows = rows.join(blocked, [*scope, "_t"], "left").filter(
        (F.col("_p.g") == 0) | F.col("_known").isNull() | ((F.col("_p.g") == 2) & (F.col("_t") == K.text_key(F.col("name"))))
    )
    own = rows.filter("_p.g = 0")
    rest = rows.filter("_p.g > 0").join(own.select(*keys, "_t").distinct(), [*keys, "_t"], "left_anti")

    def shape(df: DataFrame) -> DataFrame:
        return df.select(
            *keys, "name", F.struct(F.col("_p.g").alias("g"), F.col("_p.i").alias("i")).alias("ord"), F.col("_p.t").alias("text"),
            F.lit("other_alias").alias("alias_type"), F.lit("").alias("alias_label"), F.lit(False).alias("is_primary"),
            F.array().cast("array<string>").alias("quotes"),
        )

    kept = shape(own).select(*keys, "name", "text", "ord")
    return kept.unionByName(push_alias(shape(rest), keys).select(*keys, "name", "text", "ord"))


def resolve_identities(
    observed: DataFrame, candidates: DataFrame, texts: DataFrame, merge_decisions: DataFrame, creation_decisions: DataFrame,
    scope: Sequence[str] = ("novel_id",),
) -> DataFrame:
    """E20, one step: the ladder E7 -> E12 for observed identities against the state before them.

    Returns scope, observed_id, step, applied, cand_id. Each step only sees what earlier steps left."""
    keys = [*scope, "observed_id"]
    known = candidates.filter(F.col("source") != "alias_map").select(*scope, "display_name")
    # each step searches only what it reads, for what the steps before it left; read again below, so on reliable storage
    same = stored(score_candidates(observed, candidates, scope, AUTO_MERGE), "same")
    phrases = known_name_phrase(observed, known, scope)
    exact = exact_match(observed, candidates, same, scope)
    high = high_confidence_match(same, scope).join(exact, keys, "left_anti")
    auto = stored(exact.unionByName(high), "auto")
    left = stored(observed.join(auto.select(*keys), keys, "left_anti"), "left")
    scores = stored(review_scores(left, candidates, scope), "scores")
    review = stored(merge_review_candidate(scores, scope), "review")
    merged = apply_merge_decisions(review, merge_decisions, phrases, scope).drop("score")
    rest = left.join(review.select(*keys), keys, "left_anti")
    targets, asked = creation_targets(rest, candidates, scores.select(*keys).distinct(), texts, creation_decisions, scope)
    created = stored(apply_creation_decisions(targets, candidates, creation_decisions, phrases, scope, asked), "created")
    alone = rest.select(*keys).join(created.select(*keys), keys, "left_anti").join(
        phrases.withColumn("_phrase", F.lit(True)), keys, "left"
    ).select(
        *keys, F.lit(9).alias("step"),
        F.when(F.col("_phrase"), F.lit("reject_known_name_phrase")).otherwise(F.lit("create_new")).alias("applied"),
        F.lit(None).cast(dict(created.dtypes)["cand_id"]).alias("cand_id"),
    )
    auto = auto.select(*keys, "step", F.lit("match").alias("applied"), "cand_id")
    return auto.unionByName(merged.select(*auto.columns)).unionByName(created.select(*auto.columns)).unionByName(alone.select(*auto.columns))


def resolve_over_chapters(
    observed: DataFrame, start: DataFrame, texts: DataFrame, merge_decisions: DataFrame, creation_decisions: DataFrame,
    scope: Sequence[str] = ("novel_id",),
) -> tuple[DataFrame, DataFrame]:
    """E20 over whole novels: (outcomes, characters known at the end).

    ``observed`` also has ``position`` (0, 1, ... per novel). Chapters of one novel depend on each
    other, so the driver walks over positions; every pass resolves that position of all novels at once and sees only
    what was known before. A pass reads the observed and the texts of its position, and the characters of the novels
    that go on: outcomes, and characters of novels that end, are files of their own below the shared folder, so the plan
    of a pass does not grow with their number."""
    spark, name = observed.sparkSession, uuid.uuid4().hex
    folder = f"{ensure_checkpoint_dir(spark)}/resolve-{name}"
    kinds = dict(observed.dtypes)
    observed.withColumn("_part", F.col("position")).write.partitionBy("_part").parquet(f"{folder}/observed")
    ends = cut_lineage(observed.groupBy(*scope).agg(F.max("position").alias("_end")))
    last = ends.agg(F.max("_end")).first()[0]

    def keep(df: DataFrame, kind: str, position: int) -> None:
        df.write.parquet(f"{folder}/{kind}/position={position}")

    state = cut_lineage(start.join(ends, list(scope), "left"))
    keep(state.filter("_end IS NULL").drop("_end"), "known", -1)
    going = state.filter("_end IS NOT NULL").drop("_end")
    pass_schema = None
    for position in range(-1 if last is None else int(last) + 1):
        now = spark.read.parquet(f"{folder}/observed").filter(F.col("_part") == position).select(
            *(F.col(c).cast(kinds[c]).alias(c) for c in observed.columns if c != "position"))
        here = texts.join(now.select(*scope, "text_id").distinct(), [*scope, "text_id"], "left_semi")
        out = resolve_identities(now, going, here, merge_decisions, creation_decisions, scope)
        keep(out, "outcomes", position)
        pass_schema = out.schema
        out = spark.read.schema(pass_schema).parquet(f"{folder}/outcomes/position={position}")
        learned = stored(learn(going, now, out, scope).join(ends, list(scope)), "learned")
        keep(learned.filter(F.col("_end") <= position).drop("_end"), "known", position)
        going = learned.filter(F.col("_end") > position).drop("_end")
    known = spark.read.schema(start.schema).parquet(f"{folder}/known/position=*")
    if pass_schema is None:
        return resolve_identities(observed.drop("position"), start, texts, merge_decisions, creation_decisions, scope).withColumn("position", F.lit(0)), known
    outcomes = spark.read.schema(StructType([*pass_schema.fields, StructField("position", IntegerType())])).option(
        "basePath", f"{folder}/outcomes").parquet(f"{folder}/outcomes")
    return outcomes, known


def learn(state: DataFrame, now: DataFrame, out: DataFrame, scope: Sequence[str] = ("novel_id",)) -> DataFrame:
    """E20 between two positions: the characters known after the outcomes ``out`` of the observed ``now``.

    New names are united by key (E16) and keep the aliases that are no known name (E14); a matched
    character absorbs what was observed (E15), in all its entries of one target key. New ids are derived, so
    that they never equal the id of an earlier character."""
    keys = [*scope, "observed_id"]
    empty = F.array().cast("array<string>")
    new = out.filter("applied = 'create_new'").select(*keys).join(now, keys).withColumn("_head", K.text_key(F.col("name")))
    heads = new.groupBy(*scope, "_head").agg(F.min_by(F.struct("observed_id", "name", "text_id"), "observed_id").alias("_h"))
    known = state.select(*scope, "display_name").unionByName(heads.select(*scope, F.col("_h.name").alias("display_name")))
    said = new.join(heads, [*scope, "_head"]).select(*scope, "_head", F.col("_h.name").alias("name"), "observed_id", F.posexplode("aliases").alias("_i", "text")).select(
        *scope, "_head", "name", F.struct("observed_id", "_i").alias("ord"), "text", F.lit("other_alias").alias("alias_type"), F.lit("").alias("alias_label"),
        F.lit(False).alias("is_primary"), empty.alias("quotes"))
    kept = sanitize_new_identity(said, known, [*scope, "_head"], scope).groupBy(*scope, "_head").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]).alias("aliases"))
    fresh = heads.join(kept, [*scope, "_head"], "left").select(
        *scope, F.lit("stored").alias("source"), F.concat_ws(":", F.lit("new"), F.col("_h.observed_id").cast("string")).alias("cand_id"),
        K.ascii_key(F.col("_h.name")).alias("target_key"), F.col("_h.name").alias("display_name"), F.coalesce("aliases", empty).alias("aliases"),
        F.col("_h.text_id").alias("chapter_num"), F.col("_h.observed_id").alias("ord"))

    matches = out.filter("cand_id IS NOT NULL").select(*keys, "cand_id")
    target = matches.join(state.select(*scope, "cand_id", "target_key").distinct(), [*scope, "cand_id"]).drop("cand_id")
    taken = absorb_observed(matches, now, state, known, scope).join(target, keys).groupBy(*scope, "target_key", K.text_key(F.col("text")).alias("_k")).agg(
        F.min(F.struct(F.col("ord.g").alias("g"), "observed_id", F.col("ord.i").alias("i"), "text")).alias("_t"))
    lists = taken.groupBy(*scope, "target_key").agg(F.transform(F.array_sort(F.collect_list("_t")), lambda x: x["text"]).alias("_aliases"))
    held = state.join(lists, [*scope, "target_key"], "left").withColumn("aliases", F.coalesce("_aliases", "aliases"))
    return held.select(*fresh.columns).unionByName(fresh)


def merge_identity_list(aliases: DataFrame, scope: Sequence[str] = ("chunk_id",)) -> DataFrame:
    """Identities of one name become one; the first spelling wins, aliases are united by E4.
    ``aliases`` as in ``push_alias`` with scope columns."""
    a = aliases.withColumn("_name_key", K.text_key(F.col("name")))
    first = a.groupBy(*scope, "_name_key").agg(F.min_by("name", "ord").alias("name"))
    return push_alias(a.drop("name").join(first, [*scope, "_name_key"]), [*scope, "_name_key"]).drop("_name_key")


# --- E17-E19: alias ownership inside a chunk ---------------------------------------------------
# identity: struct(name, key, fold, aliases: array<struct(text, key, fold, primary)>)


def _owner_score(alias_fold: Column, identity: Column) -> Column:
    """E6 score of a bare alias against one identity."""
    own = F.when(strong_key(identity["fold"]), surface_similarity(alias_fold, identity["fold"])).otherwise(F.lit(0.0))
    other = F.transform(
        F.filter(identity["aliases"], lambda a: strong_key(a["fold"]) & (a["fold"] != identity["fold"])),
        lambda a: F.least(surface_similarity(alias_fold, a["fold"]), F.lit(STORED_ALIAS_SCORE)),
    )
    return F.when(strong_key(alias_fold), F.array_max(F.concat(F.array(own), other))).otherwise(F.lit(0.0))


def owner_position(ids: Column, key: Column) -> Column:
    """1-based position of the first identity with this name or alias, 0 if there is none."""
    return F.array_position(
        F.transform(ids, lambda i: (i["key"] == key) | F.exists(i["aliases"], lambda a: a["key"] == key)), True
    ).cast("int")


def redirect_owner(ids: Column, owner: Column, alias_key: Column, alias_fold: Column) -> Column:
    """Position of the owner, or of another identity that fits the alias clearly better."""
    taken = F.exists(F.transform(ids, lambda i, n: (n + 1 != owner) & (i["key"] == alias_key)), lambda b: b)

    def choose(scores: Column) -> Column:
        others = F.transform(
            scores, lambda s, n: F.when((n + 1 == owner) | (s < REDIRECT_MIN), F.lit(-1.0)).otherwise(s)
        )
        return let(
            F.struct(others.alias("o"), F.array_max(others).alias("best")),
            lambda x: F.when(
                (x["best"] >= 0) & (x["best"] > F.element_at(scores, owner) + REVIEW_GAP),
                F.array_position(x["o"], x["best"]).cast("int"),
            ).otherwise(owner),
        )

    return F.when(taken, owner).otherwise(
        let(F.transform(ids, lambda i: _owner_score(alias_fold, i)), choose)
    )


def _long_tokens(fold: Column) -> Column:
    return F.filter(F.split(fold, "_"), lambda t: F.length(t) >= 2)


def alias_grounded(identity: Column, alias_fold: Column, quote_folds: Column) -> Column:
    """The alias is in a quote, and a surface of the owner is too or shares a word with it."""
    folds = F.concat(F.array(identity["fold"]), F.transform(identity["aliases"], lambda a: a["fold"]))
    named = F.exists(quote_folds, lambda q: F.exists(folds, lambda f: (f != "") & F.contains(q, f)))
    shared = F.exists(folds, lambda f: F.arrays_overlap(_long_tokens(f), _long_tokens(alias_fold)))
    return F.exists(quote_folds, lambda q: F.contains(q, alias_fold)) & (alias_fold != "") & (named | shared)


def chunk_identities(identities: DataFrame, chunk: Sequence[str]) -> DataFrame:
    """Identities of a chunk as one array; a chunk is a bounded piece of text."""
    alias = lambda a: let(
        K.clean_surface(a),
        lambda c: F.struct(c.alias("text"), K.text_key(c).alias("key"), K.folded_key(c).alias("fold"), F.lit(False).alias("primary")),
    )
    row = F.struct(
        "ord", "name", K.text_key(F.col("name")).alias("key"), K.folded_key(F.col("name")).alias("fold"),
        F.transform(F.coalesce("aliases", F.array().cast("array<string>")), alias).alias("aliases"),
    )
    return identities.groupBy(*chunk).agg(F.array_sort(F.collect_list(row)).alias("ids"))


def prepared_ownerships(rows: DataFrame) -> DataFrame:
    """Ownership rows with everything that does not depend on the state of the chunk.
    ``rows``: chunk columns, ord, owner_name, alias_text, alias_type, confidence, quotes."""
    quotes = F.filter(F.coalesce("quotes", F.array().cast("array<string>")), lambda q: q.isNotNull())
    r = rows.withColumn("text", K.clean_surface(F.col("alias_text"))).withColumn("akey", K.text_key(F.col("text")))
    quoted = F.exists(quotes, lambda q: F.exists(
        quoted_span_array(q), lambda s: K.text_key(K.clean_surface(s["text"])) == F.col("akey")))
    return r.select(
        *rows.columns, "text", "akey", K.folded_key(F.col("text")).alias("afold"),
        K.text_key(K.clean_surface(F.col("owner_name"))).alias("okey"), V.alias_type_persistable(F.col("alias_type")).alias("typed"),
        (K.stable_alias_in_text(F.col("text"), F.col("text")) & (K.has_upper_token(F.col("text")) | quoted)).alias("fit"),
        F.transform(quotes, K.folded_key).alias("qfolds"),
    )


def apply_alias_ownership(identities: DataFrame, ownerships: DataFrame, chunk: Sequence[str] = ("chunk_id",)) -> tuple[DataFrame, DataFrame]:
    """(identities with their aliases, report). Later rows see what earlier ones did, so each chunk
    is folded in input order."""
    prepared = prepared_ownerships(ownerships).filter(
        (F.coalesce("confidence", F.lit(0.0)) >= OWNERSHIP_CONFIDENCE) & (F.col("okey") != "") & (F.col("akey") != "")
        & (F.col("okey") != F.col("akey"))
    )
    owns = prepared.groupBy(*chunk).agg(F.array_sort(F.collect_list(F.struct(
        "ord", "text", "akey", "afold", "okey", "typed", "fit", (F.col("confidence") >= 0.95).alias("primary"), "qfolds"
    ))).alias("owns"))
    packed = chunk_identities(identities, chunk).join(owns, list(chunk), "left")
    report_type = "array<struct<ord:bigint,applied:boolean,owner:string,alias:string>>"
    start = F.struct(F.col("ids").alias("ids"), F.array().cast("array<string>").alias("gone"), F.array().cast(report_type).alias("log"))

    def log(o: Column, done: bool, target: Column) -> Column:
        return F.array(F.struct(
            o["ord"].cast("long").alias("ord"), F.lit(done).alias("applied"), target["name"].alias("owner"), o["text"].alias("alias")))

    def add(target: Column, o: Column) -> Column:
        mine = F.exists(target["aliases"], lambda a: a["key"] == o["akey"])
        new = F.array(F.struct(o["text"].alias("text"), o["akey"].alias("key"), o["afold"].alias("fold"), o["primary"].alias("primary")))
        raised = F.transform(target["aliases"], lambda a: F.struct(
            a["text"].alias("text"), a["key"].alias("key"), a["fold"].alias("fold"),
            (a["primary"] | ((a["key"] == o["akey"]) & o["primary"])).alias("primary")))
        valid = o["fit"] & (o["akey"] != target["key"]) & ~((target["fold"] != "") & F.contains(o["afold"], target["fold"]))
        aliases = F.when(~valid, target["aliases"]).when(mine, raised).otherwise(F.concat(target["aliases"], new))
        return F.struct(*[target[c].alias(c) for c in ("ord", "name", "key", "fold")], aliases.alias("aliases"))

    def apply(acc: Column, o: Column, at: Column) -> Column:
        def with_target(t: Column) -> Column:
            others = F.exists(F.transform(acc["ids"], lambda i, n: (n + 1 != at) & (i["key"] == o["akey"])), lambda b: b)
            done = F.struct(
                F.transform(acc["ids"], lambda i, n: F.when(n + 1 == at, add(i, o)).otherwise(i)).alias("ids"),
                F.when(others, F.array_union(acc["gone"], F.array(o["akey"]))).otherwise(acc["gone"]).alias("gone"),
                F.concat(acc["log"], log(o, True, t)).alias("log"),
            )
            refused = F.struct(acc["ids"].alias("ids"), acc["gone"].alias("gone"), F.concat(acc["log"], log(o, False, t)).alias("log"))
            return (
                F.when(F.array_contains(acc["gone"], t["key"]) | ~o["typed"], acc)
                .when(alias_grounded(t, o["afold"], o["qfolds"]), done).otherwise(refused)
            )

        return let(F.element_at(acc["ids"], at), with_target)

    def step(acc: Column, o: Column) -> Column:
        return let(
            owner_position(acc["ids"], o["okey"]),
            lambda p: F.when((p == 0) | F.array_contains(acc["gone"], o["okey"]), acc).otherwise(
                let(redirect_owner(acc["ids"], p, o["akey"], o["afold"]), lambda at: apply(acc, o, at))
            ),
        )

    done = packed.select(*chunk, F.when(F.col("owns").isNull(), start).otherwise(F.aggregate("owns", start, step)).alias("_s"))
    left = F.filter(F.col("_s.ids"), lambda i: ~F.array_contains(F.col("_s.gone"), i["key"]))
    after = done.select(*chunk, F.explode(left).alias("_i")).select(
        *chunk, "_i.ord", "_i.name", F.transform("_i.aliases", lambda a: a["text"]).alias("aliases"),
        F.transform(F.filter("_i.aliases", lambda a: a["primary"]), lambda a: a["text"]).alias("primary_aliases"),
    )
    return after, done.select(*chunk, F.inline("_s.log"))
