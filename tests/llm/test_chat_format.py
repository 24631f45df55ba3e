from veritab.llm import chat_format

SCHEMA = "pair_id bigint, turn bigint, role string, text string, prompt string, same int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def render(role, text):
    return f"<|{role}|>\n{text}<|end|>\n"


def run(spark, chosen, rejected):
    return {r["pair_id"]: r for r in chat_format.preference_rows(table(spark, chosen), table(spark, rejected)).collect()}


def trained(text, ranges):
    return [text[int(a) : int(b)] for a, b in (x.split("-") for x in ranges.split(";") if x)]


def test_prefix_completions_and_masks(spark):
    head = [(1, 0, "system", "é"), (1, 1, "user", "hi")]
    r = run(spark, [*head, (1, 2, "assistant", "good"), (1, 3, "user", "ok"), (1, 4, "assistant", "")], [*head, (1, 2, "assistant", "bad")])[1]
    assert r["prompt_turns"] == 2 and r["prompt"] == render("system", "é") + render("user", "hi")
    assert r["chosen_completion"] == render("assistant", "good") + render("user", "ok") + render("assistant", "")
    assert r["rejected_completion"] == render("assistant", "bad")
    assert trained(r["chosen_completion"], r["chosen_trained"]) == ["good<|end|>\n", "<|end|>\n"]
    assert trained(r["rejected_completion"], r["rejected_trained"]) == ["bad<|end|>\n"]


def test_edges(spark):
    same = [(2, 0, "user", "a"), (2, 0, "user", "a"), (2, None, None, None)]
    got = run(spark, [*same, (3, 0, "user", "x"), (None, 0, "user", "n")], [*same, (4, 5, "assistant", "y" * 100_000), (None, 0, "user", "n"), (3, 9, "assistant", "x")])
    assert got[2]["prompt"] == render("user", "a") * 2 + render("", "") and got[2]["chosen_completion"] == got[2]["rejected_completion"] == ""
    assert (got[3]["prompt_turns"], got[3]["chosen_trained"], got[3]["rejected_trained"]) == (0, "", "14-23")
    assert got[4]["prompt"] == got[4]["chosen_completion"] == "" and len(got[4]["rejected_completion"]) > 100_000
    assert set(got) == {2, 3, 4}  # turns without a pair id are left out
    assert run(spark, [], []) == {}


def test_borrowed_replies(spark):
    turns = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "r1"), (2, 0, "user", "p"), (2, 1, "assistant", "r2"), (2, 2, "user", "z"), (4, 0, "user", "alone"), (None, 0, "user", "nobody's"), (None, 1, "assistant", "r")], "conv_id bigint, turn bigint, role string, text string")
    got = {r["pair_id"]: r for r in chat_format.preference_rows(*chat_format.borrowed_replies(turns)).collect()}
    assert got[1]["prompt"] == render("user", "q") and got[1]["rejected_completion"] == render("assistant", "r2") + render("user", "z")
    assert got[2]["rejected_completion"] == "" and got[4]["prompt"] == render("user", "alone")
    assert set(got) == {1, 2, 4}


def test_plan_has_no_python(spark):
    plan = chat_format.preference_rows(table(spark, []), table(spark, []))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
