"""The write path on small tables."""

from pyspark.sql import functions as F

from loamstone.operators import memory as M


def test_versions(spark):
    rows = spark.createDataFrame([(1, "a", [], 1.0, [1]), (2, "b", [("old", 0.5)], 1.0, [2])], "id long, content string, history array<struct<content:string,updated_at:double>>, updated_at double, source_message_ids array<bigint>")
    changes = spark.createDataFrame([(1, "a", [9]), (2, "c", [2, 7])], "id long, content string, source_message_ids array<bigint>")
    one, two = M.versioned(rows, changes, 5.0).orderBy("id").collect()
    assert (one.content, one.history, one.source_message_ids) == ("a", [], [1])
    assert (two.content, [tuple(h) for h in two.history], two.updated_at, two.source_message_ids) == ("c", [("old", 0.5), ("b", 1.0)], 5.0, [2, 7])


def test_threads(spark):
    steps = [("a", 1, "resolve"), ("a", 2, "create"), ("a", 3, "dismiss"), ("a", 4, "resolve"), ("a", 5, "reopen"), ("b", 1, "create"), ("b", 2, "resolve"), ("c", 1, "reopen")]
    schema = "thread string, seq int, action string, content string, follow_up string, not_before double, resolution string, at double"
    updates = spark.createDataFrame([(t, n, a, f"{a}{n}", None, None, f"{a}{n}", float(n)) for t, n, a in steps], schema)
    assert sorted(map(tuple, M.thread_states(updates).collect())) == [("a", "open", "reopen5", "", None, None, None), ("b", "resolved", "resolve2", "", None, "resolve2", 2.0)]
    blank = spark.createDataFrame([("t", 1, "create", "x", " ask ", 9.0, None, 1.0), ("t", 2, "resolve", "lost", "f", None, "  ", 2.0), ("t", 3, "update", " ", "", 5.0, None, 3.0), ("n", 1, "create", " ", None, None, None, 1.0)], schema)
    assert [tuple(r) for r in M.thread_states(blank).collect()] == [("t", "open", "x", "", 5.0, None, None)]


def test_private_statements_stay_private(spark):
    schema = "id long, content string, visibility string, disclosed_to array<string>"
    for first, second in (("public", "private"), ("private", "public")):
        rows = spark.createDataFrame([(1, "Tea", first, ["a"]), (2, " tea", second, ["b", "a"]), (3, "x", "public", [])], schema)
        assert sorted(map(tuple, M.merged_statements(rows).collect())) == [(1, "Tea", "private", ["a", "b"]), (3, "x", "public", [])]
    updates = spark.createDataFrame([(1, 1, "disclose", None, None, ["c"]), (1, 2, "revise", "Coffee", None, ["d"]), (1, 3, "disclose", None, "private", ["e"]), (1, 4, "revise", " ", None, ["z"]), (3, 1, "disclose", None, "public", ["q"]), (9, 1, "revise", "k", None, [])], "id long, seq int, operation string, content string, visibility string, people array<string>")
    rows = spark.createDataFrame([(1, "Tea", "public", ["a"]), (2, "b", "private", ["b"]), (3, "x", "private", None)], schema)
    assert sorted(map(tuple, M.updated_statements(rows, updates).collect())) == [(1, "Coffee", "private", ["d", "e"]), (2, "b", "private", ["b"]), (3, "x", "private", ["q"])]


def test_evidence_and_rendering(spark):
    updates = spark.createDataFrame([(1, [1, 2]), (2, [2]), (3, [])], "update_id int, source_message_ids array<bigint>")
    roles = spark.createDataFrame([(1, "user"), (2, "assistant")], "id long, role string")
    assert [(r.update_id, r.source_message_ids) for r in M.evidenced(updates, roles, ["user"]).collect()] == [(1, [1])]
    items = spark.createDataFrame([("s", "b", 1, "x"), ("s", None, 1, "none"), ("s", "a", 1, "z"), ("s", "b", 0, "w"), ("s", "q", 0, "other")], "section string, participant string, position int, text string")
    assert M.grouped_render(items, ["b", "a"]).first().text == "b:\nw\nx\n\na:\nz\n\nq:\nother\n\nnone"


def test_texts_and_calendar_rows(spark):
    row = spark.range(1).select(M.fact_text(F.lit("like"), F.lit("tea")), M.directive_text(F.lit("x"), F.array(F.lit("k"), F.lit("l"))), M.summary_text(F.lit("Ann"), F.array().cast("array<string>"), F.lit("s"))).first()
    assert tuple(row) == ("[like] tea", "x (keywords: k, l)", "name: Ann . summary: s")
    events = spark.createDataFrame(
        [("t", "event", 1.0, 2.0, [], None, None), ("t", "event", 2.0, 1.0, [], None, None), ("t", "routine", None, None, [0, 6, 6], "23:59", 30), ("t", "routine", None, None, [7], "09:00", 30), (" ", "event", 1.0, 2.0, [], None, None)],
        "title string, kind string, start_at double, end_at double, weekdays array<int>, start_local string, duration_minutes int",
    ).withColumn("attendees", F.array(F.lit("a"), F.lit("a")))
    assert [r.valid for r in M.normalised_events(events).collect()] == [True, False, True, False, False]


def test_world(spark):
    states = spark.createDataFrame([("me", "home", False, "idle"), ("you", "home", False, "cook"), ("far", "sea", False, "swim"), ("star", "sea", True, "sing")], "actor string, location string, is_public boolean, activity string")
    facts = spark.createDataFrame([(1, "local", "home", None, [], "a", 1.0), (2, "local", "sea", None, [], "b", 2.0), (3, "known", None, 5.0, [], "c", 3.0), (4, "private", None, 50.0, ["me"], "d", 4.0)], "id long, visibility string, location string, valid_until double, witnesses array<string>, content string, occurred_at double")
    assert [(r.kind, r.id) for r in M.world_snapshot(states, facts, "me", 10.0).collect()] == [("actor", "you"), ("actor", "star"), ("fact", "4"), ("fact", "1")]
    actions = spark.createDataFrame([("a", "pending", 9.0, "go"), ("a", "done", 1.0, "x")], "actor string, status string, due_at double, name string")
    routines = spark.createDataFrame([("a", 3.0, "r"), ("b", 4.0, "s"), ("b", 1.0, "past")], "actor string, start double, routine string")
    assert sorted(map(tuple, M.next_action(actions, routines, 2.0).collect())) == [("a", 9.0, "go"), ("b", 4.0, "s")]
