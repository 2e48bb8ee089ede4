"""Steps of the resolver that search only what they read give the results of all scores."""
import random

from pyspark.sql import functions as F

from loreweave.operators import identity as E

CAND = "novel_id int, source string, cand_id string, target_key string, display_name string, aliases array<string>, chapter_num bigint, ord string"
SYLLABLES = ["mar", "tin", "del", "or", "sa", "ven", "ka", "lo"]


def made(spark, seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice(SYLLABLES) for _ in range(n)).title()
    cand, seen, texts, merge, create = [], [], [], [], []
    for novel in (1,):
        names = sorted({f"{word(2)} {word(rng.randint(1, 2)).lower()}" for _ in range(24)})
        for k, n in enumerate(names):
            # several sources under one target key, with names of their own
            cand.append((novel, ("stored", "working", "alias_map")[k % 3], f"c{k}", f"t{k // 2 if k < 12 else k}", n, [n.split()[0]] if k % 4 else [], k, f"{k:03}"))
        for k, n in enumerate(names):
            other = names[(k * 7 + 3) % len(names)]
            name = (n, n.replace("ar", "a"), f"{n} esten", f"Ofer {other}", f"Zzyqx{k} wwjjh", f"Qq {n.split()[0]}")[k % 6]
            seen.append((novel, f"o{k}", k % 5, name, [other.split()[0]] if k % 3 == 0 else []))
            merge.append((novel, f"o{k}", ("merge", "ignore", "other")[k % 3], 0.9))
            create.append((novel, f"o{k}", ("merge", "merge", "reject")[k % 3], 0.9, f"t{k % 9}" if k % 2 else None, other.split()[0] if k % 5 else n))
        texts += [(novel, t, " and ".join(names[t::5])) for t in range(5)]
    return (
        spark.createDataFrame(seen, "novel_id int, observed_id string, text_id int, name string, aliases array<string>"), spark.createDataFrame(cand, CAND),
        spark.createDataFrame(texts, "novel_id int, text_id int, text string"),
        spark.createDataFrame(merge, "novel_id int, observed_id string, action string, confidence double"),
        spark.createDataFrame(create, "novel_id int, observed_id string, action string, confidence double, target_key string, target_name string"),
    )


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select("novel_id", "observed_id", *cols).collect())


def test_creation_decisions_search_only_names_without_an_equal_one(spark, monkeypatch):
    """All pairs of a novel were scored, though a decision names one candidate by key or name."""
    seen, cand, texts, _, told = made(spark, 3)
    phrases = E.known_name_phrase(seen, cand)
    full = E.creation_review_candidates(seen, cand, E.cut_lineage(E.score_candidates(seen, cand)), texts)
    want = rows(E.apply_creation_decisions(full, cand, told, phrases), "applied", "cand_id")
    searched, near = [], E.near_keys
    monkeypatch.setattr(E, "near_keys", lambda left, right, *more: (searched.extend(r.skey for r in left.collect()), near(left, right, *more))[1])
    targets, asked = E.creation_targets(seen, cand, E.scored_identities(seen, cand), texts, told)
    assert rows(E.apply_creation_decisions(targets, cand, told, phrases, asked=asked), "applied", "cand_id") == want
    assert sum(r[3] is not None for r in want) > 5 and {"merge_existing", "reject", "create_new"} <= {r[2] for r in want}
    known = {r.skey for r in E.resolution_surfaces(cand.withColumnRenamed("display_name", "name"), ["novel_id", "cand_id"]).collect()}
    assert searched and not known & set(searched)


def test_resolver_steps_search_only_what_is_left(spark):
    """The ladder over all scores, as it was."""
    seen, cand, texts, merge, create = made(spark, 5)
    scores, phrases, keys = E.cut_lineage(E.score_candidates(seen, cand)), E.known_name_phrase(seen, cand.filter("source <> 'alias_map'")), ["novel_id", "observed_id"]
    exact = E.exact_match(seen, cand, scores)
    auto = E.cut_lineage(exact.unionByName(E.high_confidence_match(scores).join(exact, keys, "left_anti")))
    review = E.cut_lineage(E.merge_review_candidate(scores).join(auto, keys, "left_anti"))
    merged = E.apply_merge_decisions(review, merge, phrases).drop("score")
    rest = E.cut_lineage(seen.join(auto, keys, "left_anti").join(review.select(*keys), keys, "left_anti"))
    short = E.creation_review_candidates(rest, cand, scores.join(rest.select(*keys), keys, "left_semi"), texts)
    created = E.apply_creation_decisions(short, cand, create, phrases)
    want = rows(auto.withColumn("applied", F.lit("match")).unionByName(merged.select(*keys, "step", "cand_id", "applied")).unionByName(created), "step", "applied", "cand_id")
    got = rows(E.resolve_identities(seen, cand, texts, merge, create), "step", "applied", "cand_id")
    assert [r for r in got if r[2] < 9] == want and {1, 7, 8} <= {r[2] for r in want}
