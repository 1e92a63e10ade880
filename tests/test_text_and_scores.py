import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from graphsets.functions import answers, jsonsafe, templates, text, tokens
from graphsets.operators import examples, report, score
from graphsets.sources import jsonl
from tests import model


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "given,want",
    [
        ("no mark", "no mark"),
        ("So. The answer is 5.", "So. The answer is \\boxed{5}."),
        ("The answer is 1. The answer is ..2.. ", "The answer is 1. The answer is \\boxed{2.. }."),
        ("a\nThe answer is b\nc.\n", "a\nThe answer is \\boxed{b\nc.\n}."),
        ("The answer is ", "The answer is \\boxed{}."),
        (None, None),
    ],
)
def test_instruction_answer(spark, given, want):
    assert one(spark, given, text.instruction_answer) == want


@pytest.mark.parametrize(
    "given,want",
    [
        ("x \\boxed{1} y \\boxed{2}", "2"),
        ("\\boxed{a{b{c}d}e}", "a{b{c}d}e"),
        ("\\boxed{a{b{c{d}}}}", None),
        ("none", None),
        ("\\boxed{}", ""),
        ("\\boxed{open", None),
        ("\\boxed{two\nlines}", "two\nlines"),
        ("\\boxed{" + "x" * 50_000 + "}", "x" * 50_000),
        ("\\boxed{" + "{y}" * 20_000 + "}", "{y}" * 20_000),
        (None, None),
    ],
)
def test_last_boxed(spark, given, want):
    assert one(spark, given, answers.last_boxed) == want


@pytest.mark.parametrize(
    "given,want",
    [
        ("(B).", "b"), ("(B)..", "(B).."), ("(B)", "b"), ("B.", "b"), ("option c", "c"), ("Option (D):", "d"), ("f", "f"),
        ("Yes.", "yes"), (" NO . )", "no"),
        ("B and A are independent", "a and b are independent"),
        ("There is no relation between A and B.", "a and b are independent"),
        ("A is an  ancestor\tof B", "A is an ancestor of B"),
        ("A is an ancestor of B.", "A is an ancestor of B."),
        ("\u00a0Ｙｅｓ\u3000", "yes"), ("①", "1"), ("ﬁn", "fin"), ("a\x1cb", "a b"),
        ("", ""),
    ],
)
def test_canonical(spark, given, want):
    rows = spark.createDataFrame([(given,)], "x string")
    assert score.canonical_answers(rows, "x", "y").first().y == want


def test_pass_at_k(spark):
    cases = [(n, c, k) for n in range(1, 17) for c in range(n + 1) for k in range(1, 20)]
    rows = spark.createDataFrame(cases, "n bigint, c bigint, k bigint")
    got = rows.withColumn("p", answers.pass_at_k(F.col("n"), F.col("c"), F.col("k"))).collect()
    assert all(math.isclose(r.p, model.pass_at_k(r.n, r.c, r.k), abs_tol=1e-12) for r in got)
    named = {(r.n, r.c, r.k): r.p for r in got}
    assert abs(named[16, 3, 4] - 0.607142857) < 1e-9
    assert named[16, 0, 4] == 0 and named[1, 0, 2] == 1 and named[5, 5, 1] == 1


def test_scoring(spark):
    rows = spark.createDataFrame(
        [
            (1, "A and B are independent", "t", ["x \\boxed{B and A are independent.}", "no box", "\\boxed{no}"]),
            (2, "yes", None, ["\\boxed{Ｙes.}"]),
        ],
        "example_id bigint, answer string, primary_inference_type string, generated_text array<string>",
    )
    scored = score.score_samples(score.columns_to_rows(rows)).cache()
    per = score.example_accuracy(scored)
    assert {(r.example_id, r.samples, r.correct) for r in per.collect()} == {(1, 3, 1), (2, 1, 1)}
    card = {r.metric: r.value for r in score.scorecard(per, 2).collect()}
    assert abs(card["accuracy"] - 2 / 3) < 1e-12 and card["acc_None"] == 1.0
    assert abs(card["pass_at_2"] - (model.pass_at_k(3, 1, 2) + 1) / 2) < 1e-12
    first = score.prediction_report(scored, 2).filter("example_id = 1").first()
    assert first.predictions == ["B and A are independent.", None, "no"]
    assert first.pass_at_k[1] == pytest.approx(1 / 3) and len(first.texts) == 3
    back = score.rows_to_columns(score.columns_to_rows(rows)).orderBy("example_id").collect()
    assert [r.generated_text for r in back] == [r.generated_text for r in rows.orderBy("example_id").collect()]


def test_entity_names(spark):
    names = [r.entity for r in text.entity_names(spark, 676).orderBy("position").collect()]
    assert names[:2] == ["AA", "AB"] and names[26] == "BA" and names[-1] == "ZZ" and len(set(names)) == 676
    with pytest.raises(ValueError):
        text.entity_names(spark, 677)
    with pytest.raises(PySparkException):
        one(spark, 676, text.entity_name, "bigint")


@pytest.mark.parametrize(
    "given,want",
    [("Rule  Type!", "rule_type"), (None, "unknown"), ("", "unknown"), ("--", "unknown"), ("__a__b", "a_b"), ("É1", "é1")],
)
def test_slug(spark, given, want):
    assert one(spark, given, text.metric_slug) == want


def test_json_safe(spark):
    got = [one(spark, v, text.json_safe, "double") for v in (1.5, float("nan"), float("inf"), float("-inf"), None)]
    assert got == [1.5, None, None, None, None]


def test_nested_results_come_back(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    schema = (
        "id int, plain string, flat double, list array<float>, deep array<struct<v:double, m:map<int,array<double>>>>, "
        "tags array<string>, inner struct<tags:array<double>, `odd name`:map<boolean,string>>, nothing array<double>"
    )
    rows = [
        (1, "x", nan, [1.0, inf, None], [(nan, {1: [nan, 2.0], 2: None}), None], ["b", "a", "b"], ([2.0, inf, 1.0, 2.0], {True: "t"}), None),
        (2, None, -inf, [], [], None, None, [nan]),
    ]
    df = spark.createDataFrame(rows, schema)
    path = str(tmp_path / "results")
    jsonl.write_results(df, path, sets=["tags", "inner.tags"])
    back = {r.id: r.asDict(recursive=True) for r in jsonl.scan_results(spark, path, df.schema).collect()}
    assert back[1] == {
        "id": 1, "plain": "x", "flat": None, "list": [1.0, None, None],
        "deep": [{"v": None, "m": {"1": [None, 2.0], "2": None}}, None], "tags": ["a", "b"],
        "inner": {"tags": [1.0, 2.0, None], "odd name": {"true": "t"}}, "nothing": None,
    }
    assert back[2] == {"id": 2, "plain": None, "flat": None, "list": [], "deep": [], "tags": None, "inner": None, "nothing": [None]}
    flat = df.select("id", "plain")
    assert jsonsafe.json_ready(flat).collect() == flat.collect()


def test_token_lengths_equal_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    texts = ["", " ", "plain words", "Ünïcödé 𝔘 words", None, "long " * 5000, "a\n\nb"] * 40
    df = spark.createDataFrame([(t,) for t in texts], "prompt string").repartition(3)
    length = tokens.token_lengths(spark, path)
    for row in df.select("prompt", length(F.col("prompt")).alias("n")).collect():
        assert row.n == (None if row.prompt is None else len(tokenizer.encode(row.prompt, add_special_tokens=False).ids))
    assert report.prompt_overflow(df, 1000, length=length).count() == 40


def test_token_count(spark):
    for given, want in (("", 0), ("  ", 0), ("a", 1), (" a  b\nc\u00a0d ", 4)):
        assert one(spark, given, text.token_count, "string") == want


def test_chat(spark):
    rows = spark.createDataFrame([("hi", "yo", "", "sys")], "u string, a string, e string, s string")
    u, a, e, s = (F.col(c) for c in "uaes")
    got = rows.select(
        text.chat_text(u, open_assistant=True).alias("open"), text.chat_text(u, a).alias("full"),
        text.chat_text(u, system=s).alias("sys"), text.chat_text(u, system=e).alias("nosys"),
        text.chat_text(u, raw=True).alias("raw"),
        text.chat_text(u, message=lambda role, content: F.lit(None).cast("string")).alias("failed"),
    ).withColumn("suffix", text.completion_suffix(F.col("full"), F.col("open"))).first()
    assert got.open == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\n"
    assert got.suffix == "yo<|im_end|>\n"
    assert got.sys.startswith("<|im_start|>system\nsys<|im_end|>\n") and got.nosys == got.open[: len(got.nosys)]
    assert got.raw == got.failed == "hi"


def test_prompt_limits(spark):
    rows = spark.createDataFrame([("a b c",), ("a",)], "prompt string")
    assert [r.prompt_len for r in report.prompt_overflow(rows, 2).collect()] == [3]
    with pytest.raises(PySparkException, match="overflow"):
        report.require_prompts_fit(rows, 2).collect()
    assert report.require_prompts_fit(rows, 3).count() == 2


def test_eleven_templates_asked_gives_ten(spark):
    rows = spark.createDataFrame([("rule",)], "family string")
    assert templates.fan_out(rows, 11).count() == 10
    assert templates.fan_out(rows, 3).count() == 3


def test_observation_wording(spark):
    rows = spark.createDataFrame(
        [(0, 0, 0, "Q", ["A"], ["1"], "1", ["ancestor"], "ancestor"), (0, 0, 1, "Q", ["A", "B"], ["1", "0"], "0", ["ancestor"], "ancestor")],
        "graph_idx bigint, world_id bigint, spec_ord bigint, query_entity string, observed_entities array<string>, "
        "observed_values array<string>, answer string, inference_types array<string>, primary_inference_type string",
    )
    made = examples.render_observations(examples.observation_rows(rows, 10)).collect()
    assert len(made) == 20
    prompts = {r.prompt for r in made}
    assert {"Given: A is 1. Query: Q", "A is 1, B is 0. Determine Q.", "Given: A is 1 and B is 0. Query: Q"} <= prompts
    assert {r.completion for r in made} == {"\\boxed{1}", "\\boxed{0}"}


def test_inserted_names_are_not_placeholders(spark):
    rows = spark.createDataFrame([("{P2}", "B")], "a string, b string")
    prompt = templates.fill("between {P1} and {P2}? {answer} {P1}", {"{P1}": F.col("a"), "{P2}": F.col("b")})
    assert rows.select(prompt).first()[0] == "between {P2} and B? {answer} {P2}"


def test_first_rows_with_ties_and_nulls(spark):
    rows = spark.createDataFrame([(1, "x"), (1, "y"), (1, "z"), (None, "n"), (2, "w")], "k int, v string")
    for count in range(7):
        got = [(r.k, r.v) for r in examples.first_rows(rows, ["k"], count).collect()]
        assert sorted(got, key=str) == sorted([(None, "n"), (1, "x"), (1, "y"), (1, "z"), (2, "w")][:count], key=str)


def test_a_missing_fact_is_an_error(spark):
    rows = spark.createDataFrame([(0, 0, "Q", ["A"])], "graph_idx bigint, world_id bigint, query_entity string, observed_entities array<string>")
    words = spark.createDataFrame([(0, "A", 0, 1)], "graph_idx bigint, entity string, word int, bits bigint")
    with pytest.raises(PySparkException, match="no fact of Q"):
        examples.observe(rows, words, 1).collect()


def test_open_turn_in_other_markup(spark):
    rows = spark.createDataFrame([("hi",)], "u string")
    def mark(role, content):
        return F.concat(F.lit(f"<{role}>"), content)
    text_ = text.chat_text(F.col("u"), open_assistant=True, message=mark, header=lambda role: F.lit(f"<{role}>"))
    assert rows.select(text_).first()[0] == "<user>hi<assistant>"
    with pytest.raises(ValueError):
        text.chat_text(F.col("u"), open_assistant=True, message=mark)


def test_copies(spark):
    rows = spark.createDataFrame(
        [("train", "explanation", "a"), ("val", "explanation", "b"), ("train", "observation", "c")],
        "split string, kind string, row_key string",
    )
    got = sorted(r.row_key for r in examples.train_explanation_copies(rows, 2).collect())
    assert got == ["a", "a|copy1", "a|copy2", "b", "c"]
    assert examples.train_explanation_copies(rows, 0).count() == 3


def test_eval_splits_with_a_shared_slug(spark):
    rows = spark.createDataFrame(
        [("rule_explanation", "b b", "1"), ("rule_explanation", "B-b", "2"), ("rule_explanation", None, "3"), ("ancestor", None, "4")],
        "primary_inference_type string, explanation_type string, row_key string",
    )
    got = sorted((r.eval_split, r.row_key) for r in report.eval_split_fanout(rows).collect())
    stem = "validation_rule_explanation_type_"
    assert got == sorted(
        [("validation", k) for k in "1234"] + [(stem + "b_b", "2"), (stem + "unknown", "3")]
    )


def test_counts_of_nothing(spark):
    rows = spark.createDataFrame(
        [], "split string, kind string, inference_types array<string>, primary_inference_type string, explanation_type string, answer string"
    )
    for r in report.split_breakdown(rows).collect():
        assert (r.observation_types, r.explanation_types, r.relationship_truths) == ("none", "none", "none")


def test_natural_order(spark):
    rows = spark.createDataFrame([(n,) for n in ("m-10", "m-9", "other", "m-x", "m-100", "a")], "name string")
    assert [r.name for r in report.natural_order(rows, "name", "m-").collect()] == ["m-9", "m-10", "m-100", "a", "m-x", "other"]
