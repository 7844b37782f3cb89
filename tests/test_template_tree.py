"""Templates by similarity: merging in the leaves of the prefix tree."""

import random

from alertloom.operators import template_tree


def mined(spark, *messages):
    rows = spark.createDataFrame([(m,) for m in messages], "message string")
    return {r["template"]: (r["n"], r["variants"]) for r in template_tree.mined_templates(rows).collect()}


def brute(messages):
    """Final template of each distinct message, by the rules of the module."""
    now = {m: m for m in messages}
    for a, b in template_tree.PLACES:
        counts = {}
        for m in messages:
            counts[now[m]] = counts.get(now[m], 0) + 1
        leaves = {}
        for t in counts:
            words = t.split(" ")
            if len(words) > 1:
                leaves.setdefault((len(words), words[a], words[b]), []).append(t)
        moved = {}
        for entries in leaves.values():
            head = min(entries, key=lambda t: (-counts[t], t)).split(" ")
            odd = {t: [i for i, w in enumerate(t.split(" ")) if w != head[i]] for t in entries}
            near = [t for t in entries if 100 * (len(head) - len(odd[t])) >= template_tree.SIMILARITY * len(head)]
            holes = {i for t in near for i in odd[t]}
            if holes:
                merged = " ".join("<*>" if i in holes else w for i, w in enumerate(head))
                moved |= {t: merged for t in near}
        now = {m: moved.get(t, t) for m, t in now.items()}
    return now


def test_two_varying_tokens_merge(spark):
    messages = [f"user {u} logged in from {h} by key" for u in ("ann", "bob", "eve") for h in ("alpha", "beta")]
    assert mined(spark, *messages, "disk full") == {"user <*> logged in from <*> by key": (6, 6), "disk full": (1, 1)}


def test_varying_first_token_merges_in_a_later_round(spark):
    assert mined(spark, *[f"{w} service has been started now" for w in ("cron", "sshd", "ntpd")]) == {
        "<*> service has been started now": (3, 3)}


def test_dissimilar_messages_of_one_leaf_stay_apart(spark):
    assert mined(spark, "job run a b c d e", "job run v w x y z") == {
        "job run a b c d e": (1, 1), "job run v w x y z": (1, 1)}


def test_equals_brute_force(spark):
    rng = random.Random(1)
    messages = [" ".join(rng.choice(["up", "down", "left", "go", "at"]) for _ in range(rng.randint(1, 6)))
                for _ in range(400)]
    want, counts = brute(messages), {}
    for m in messages:
        counts[want[m]] = counts.get(want[m], 0) + 1
    assert {t: n for t, (n, _) in mined(spark, *messages).items()} == counts


def test_every_message_is_labelled(spark):
    rows = spark.createDataFrame(
        [(1, "login of ann failed", "x"), (1, "login of ann failed", "x"), (2, "login of bob failed", "y"),
         (3, None, "z"), (4, "", None)], "id int, message string, merged string")
    got = [(r["id"], r["template"]) for r in template_tree.labelled_messages(rows).collect()]
    assert sorted(got, key=str) == [(1, "login of <*> failed"), (1, "login of <*> failed"),
                                    (2, "login of <*> failed"), (3, None), (4, "")]


def test_no_messages(spark):
    assert mined(spark) == {}


def test_only_shared_leaves_are_compared(spark):
    """Texts alone in their leaf stay behind a semi-join, and token arrays are never shuffled."""
    from alertloom.operators.template_tree import merge_round
    rows = [("a b c d", 1), ("a b c e", 1), ("a b x", 5), ("z b c d", 2), ("", 1), ("a", 1)]
    merged = merge_round(spark.createDataFrame(rows, "template string, n long"), (0, 1))
    assert {tuple(r) for r in merged.collect()} == {("a b c d", "a b c <*>"), ("a b c e", "a b c <*>")}
    plan = merged._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "head_words" not in plan
