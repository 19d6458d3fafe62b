import json

import pytest
from pyspark.sql import functions as F

from corpusmill import operators as O
from corpusmill import sources as S
from corpusmill.functions import chat as C
from corpusmill.functions import text as T
from corpusmill.functions import urls as U
from corpusmill.functions.html import markdown_of
from corpusmill.operators import providers as P
from corpusmill.streaming import clean_stream


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    "rule,before,after",
    [
        (T.NORMALISE["txt_punct_spacing"], "a , b", "a, b"), (T.NORMALISE["txt_punct_spacing"], "a\n\n! b", "a! b"),
        (T.MARKDOWN["md_link_text"][0], '[t](/u "x")', "t"), (T.NORMALISE["txt_abbr_defs"], "  *[DE]: Deutsch", ""),
        (T.PII["ip_address"], "at 10.0.0.1 now", "at [IP_ADDRESS] now"),
        (T.PII["social_security_number"], "123-45-6789 123456789", "[SSN] [SSN]"),
    ],
)
def test_rules(spark, rule, before, after):
    assert one(spark, rule(F.col("t")), t=before) == after


def test_images_after_links(spark):
    assert one(spark, T.apply_rules(F.col("t"), [*T.MARKDOWN["md_link_text"], *T.MARKDOWN["md_images"]]), t="![alt](u)") == "!alt"


@pytest.mark.parametrize("url,out", [("https://www.a.example/x/?q=1#f", "https://a.example/x"), ("https://a.example/", "https://a.example")])
def test_url_normalize(spark, url, out):
    assert one(spark, U.url_normalize(F.col("u")), u=url) == out


def test_clean_keeps_rows_with_first_reason(spark):
    rows = [(1, "x" * 199), (2, "x" * 200), (3, "x" * 100_001), (4, "gonna " + "y " * 200), (5, "beklemmend " * 30), (6, None)]
    got = {r["doc_id"]: r["cleaning_reason"] for r in O.clean(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "length", 2: None, 3: "length", 4: "slang", 5: None, 6: "empty"}


@pytest.mark.parametrize("n,sizes", [(10, (8, 1, 1)), (7, (5, 1, 1))])
def test_split_sizes(spark, n, sizes):
    rows = O.hash_split(spark.range(n).withColumnRenamed("id", "k"), "k").groupBy("split").count().collect()
    got = {r["split"]: r["count"] for r in rows}
    assert tuple(got.get(s, 0) for s in ("train", "valid", "test")) == sizes


def test_padding(spark):
    assert [one(spark, C.padded_length(F.lit(n))) for n in (8, 9)] == [8, 16]


def test_template_with_tools_and_thoughts(spark):
    ms = [("user", "q"), ("assistant", "<think>\nwhy\n</think>\n\nans"), ("tool", "r1"), ("tool", "r2"), ("assistant", "done")]
    df = spark.createDataFrame([(ms, ["{}"])], "ms array<struct<role:string,content:string>>, tools array<string>")
    text = df.select(C.template_render(F.col("ms"), F.col("tools"), True, False)).first()[0]
    assert text.startswith("<|im_start|>system\n# Tools") and "<tools>\n{}\n</tools>" in text
    assert "<think>\nwhy\n</think>\n\nans<|im_end|>" in text
    assert "<|im_start|>user\n<tool_response>\nr1\n</tool_response>\n<tool_response>\nr2\n</tool_response><|im_end|>\n" in text
    assert text.endswith("<think>\n\n</think>\n\ndone<|im_end|>\n<|im_start|>assistant\n<think>\n\n</think>\n\n")


def test_markdown():
    assert markdown_of("<h1>T</h1><p><b>x</b> <a href='/u'>l</a><script>no()</script></p>") == "# T\n\n**x** [l](/u)"
    assert markdown_of(None) == ""


def test_sources(spark, tmp_path):
    (tmp_path / "urls.txt").write_text("  https://a.example/x  \n\n# note\n")
    assert [r["url"] for r in S.url_list(spark, str(tmp_path / "urls.txt")).collect()] == ["https://a.example/x"]
    (tmp_path / "q.jsonl").write_text('{"hash": "h", "question": "q"}\n\nnot json\n')
    assert S.jsonl(spark, str(tmp_path / "q.jsonl")).count() == 1
    with pytest.raises(Exception):
        S.jsonl(spark, str(tmp_path / "q.jsonl"), strict=True).collect()
    assert S.index_json(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "index.json").write_text(json.dumps([{"hash": "h", "depth": 1}]))
    assert S.index_json(spark, str(tmp_path / "index.json")).count() == 1
    (tmp_path / "md").mkdir()
    (tmp_path / "md" / "a.md").write_text("a\nb")
    assert [tuple(r) for r in S.text_files(spark, str(tmp_path / "md")).collect()] == [("a.md", "a\nb")]
    assert S.folder_bytes(spark, str(tmp_path / "md")) == 3 and S.folder_bytes(spark, str(tmp_path / "no")) == 0
    (tmp_path / "runs" / "r1").mkdir(parents=True)
    (tmp_path / "runs" / "r1" / "summary.json").write_text('{"stats": {"total_questions": 1}}')
    assert S.run_summaries(spark, str(tmp_path / "runs")).first()["run_dir"] == "r1"
    (tmp_path / "c.yaml").write_text("a: 1\n")
    assert S.read_yaml(spark, str(tmp_path / "c.yaml")).override(b=2).values == {"a": 1, "b": 2}
    (tmp_path / "l.yaml").write_text("- 1\n")
    with pytest.raises(TypeError):
        S.read_yaml(spark, str(tmp_path / "l.yaml"))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("h", "ü")], "hash string, text string")
    S.write_jsonl(df, str(tmp_path / "j"))
    S.write_jsonl(df, str(tmp_path / "j"), append=True)
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    S.write_keyed(df, str(tmp_path / "p"), "hash")
    assert spark.read.parquet(str(tmp_path / "p")).count() == 1


def test_providers(spark):
    rows = P.complete(spark.createDataFrame([(1, "p")], "id long, p string"), "p", "id").collect()
    assert json.loads(rows[0]["reply"])["score"] == 0.5
    assert P.yaml_scalar_replace("a: 1\nb: 2", "b", "3") == "a: 1\nb: 3"
    with pytest.raises(KeyError):
        P.yaml_scalar_replace("a: 1", "z", "1")
    assert P.lift_key({"r": {"t": 5}}, "r", "t") == {"r": {"t": 5}, "t": 5}


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "x " * 200)], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    q = clean_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), "doc_id long, text string")
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).first()["cleaning_status"] == "kept"


def test_html_text_after_an_open_head():
    from corpusmill.functions.html import markdown_of

    assert markdown_of("<html><head><title>x</title><body><p>hello <b>you</b>") == "hello **you**"
    page = "<head><title>t</title><style>a{}</style></head><body><h2>Head</h2><p>One <a href='/u'>link</a>.</p><script>x()</script><ol><li>a<li>b</ol></body>"
    assert markdown_of(page) == "## Head\n\nOne [link](/u).\n\n  1. a\n  2. b"


def test_links_like_a_parser(spark):
    from html.parser import HTMLParser

    html = """<a href="/1">x</a><A HREF='/2?a=1&amp;b=2'>y</A><a href=/3>z</a><a class="k" href = "/4">w</a><a data-href="/no">n</a>
    <abbr href="/no2">q</abbr><a title=" href=/no3 " href="/5">t</a><a name="n">m</a><a\nhref="/6"\n>l</a>"""

    class Anchors(HTMLParser):
        found = ()

        def handle_starttag(self, tag, attrs):
            if tag == "a" and dict(attrs).get("href") is not None:
                self.found = (*self.found, dict(attrs)["href"])

    parser = Anchors()
    parser.feed(html)
    got = spark.createDataFrame([(html,)], "html string").select(U.html_links(F.col("html"))).first()[0]
    assert got == list(parser.found) and len(got) == 6


def test_links_resolve_like_urljoin(spark):
    from urllib.parse import urljoin

    bases = ["https://a.example/x/y/z.html?q=1#f", "https://a.example/x/y/", "https://a.example", "http://a.example/p"]
    links = ["../q", "./q", "../../../q", "q/../r/./s", "/m/../n", "..", ".", "../", "?k=2", "#g", "", "//b.example/t", "https://c.example/u/../v", "mailto:x@y.example", "a/b?x=../y"]
    rows = [(b, h) for b in bases for h in links]
    got = spark.createDataFrame(rows, "b string, h string").select("b", "h", U.url_absolute(F.col("b"), F.col("h")).alias("u")).collect()
    assert [(b, h, u, urljoin(b, h)) for b, h, u in got if u != urljoin(b, h)] == []


def test_top_level_yaml_scalars():
    text = "a:\n  b: 1\nb: 2  \nc:\nb: 4\n"
    assert P.yaml_scalar_replace(text, "b", "3") == "a:\n  b: 1\nb: 3\nc:\nb: 4\n"
    assert P.yaml_scalar_replace(text, "c", "x") == "a:\n  b: 1\nb: 2  \nc: x\nb: 4\n"
    with pytest.raises(KeyError):
        P.yaml_scalar_replace("a:\n  b: 1\n", "b", "3")


def test_template_with_tool_calls_and_reasoning(spark):
    kind = "array<struct<role:string,content:string,reasoning_content:string,tool_calls:array<struct<name:string,arguments:string>>>>"
    calls = [("f", '{"x": 1}'), ("g", "{}")]
    ms = [("user", "hi", None, None), ("assistant", "\nlook", "think", calls), ("tool", "r", None, None), ("assistant", "", None, calls[:1]), ("user", "ok", None, None), ("assistant", "bye", "", [])]
    text = spark.createDataFrame([(ms,)], f"ms {kind}").select(C.template_render(F.col("ms"), fields=("reasoning_content", "tool_calls"))).first()[0]
    call = lambda n, a: f'<tool_call>\n{{"name": "{n}", "arguments": {a}}}\n</tool_call>'
    assert text == (
        "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\n\nlook\n" + call(*calls[0]) + "\n" + call(*calls[1]) + "<|im_end|>\n"
        "<|im_start|>user\n<tool_response>\nr\n</tool_response><|im_end|>\n<|im_start|>assistant\n" + call(*calls[0]) + "<|im_end|>\n"
        "<|im_start|>user\nok<|im_end|>\n<|im_start|>assistant\n<think>\n\n</think>\n\nbye<|im_end|>\n"
    )


def test_second_pass_and_pdf(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "ccc")], "k long, p string")
    kept, removed = P.second_pass(rows, "p", "k", lambda ps: ["Irrelevant." if len(p) == 2 else "broken {" for p in ps])
    assert {r["k"] for r in kept.collect()} == {1, 3} and [(r["k"], r["reply"]) for r in removed.collect()] == [(2, "Irrelevant.")]
    files = spark.createDataFrame([("a", bytearray(b"x")), ("b", bytearray(b"bad")), ("c", None)], "path string, content binary")
    got = P.pdf_to_markdown(files, lambda data: "# " + data.decode() if data == b"x" else 1 / 0).collect()
    assert [tuple(r) for r in got] == [("a", "# x")]


def test_tokens_are_the_librarys(spark):
    from tokenizers import Tokenizer

    import public_tokenizers
    from corpusmill.functions.tokens import tokenize

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["one two  three", None, "ü " * 700, ""]
    got = {r["k"]: r for r in tokenize(spark.createDataFrame(list(enumerate(texts)), "k long, text string"), "k", "text").collect()}
    for k, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids[:512]
        assert got[k]["input_ids"] == ids and got[k]["attention_mask"] == [1] * len(ids) and got[k]["seq_len"] == len(ids)


def test_ranges_agree_with_one_window(spark):
    rows = [(i, "ab"[i // 7 % 2], 5 if i % 3 else i % 11) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, h string, n long")
    same = {r["id"]: r["same"] for r in O.lag_equal(df, "id", "h", 9).collect()}
    assert same == {i: i > 0 and rows[i - 1][1] == h for i, h, _ in rows}
    rank = {r["id"]: r["rank"] for r in O.global_rank(df, "n", "id", 9).collect()}
    assert rank == {i: k + 1 for k, (_, i) in enumerate(sorted((n, i) for i, _, n in rows))}
    blocks = {r["block"]: r["ids"] for r in O.pack_blocks(df.select(F.col("id").alias("doc_id"), F.expr("transform(sequence(1, int(id % 40)), x -> int(id))").alias("ids")), 64).collect()}
    flat = [x for i in range(400) for x in [*[i] * (i % 40 or 2), 0]]  # a sequence from 1 to 0 has two values
    assert blocks == {b: flat[64 * b : 64 * b + 64] for b in range(-(-len(flat) // 64))}


def test_model_dirs(spark, tmp_path):
    from corpusmill import sources as S

    for name, file in (("m-hpo_1", "w.safetensors"), ("m-hpo_2", "notes.txt"), ("plain", "w.safetensors"), ("a-hpo_0", "w.safetensors")):
        (tmp_path / name).mkdir()
        (tmp_path / name / file).write_text("x")
    assert [r["name"] for r in S.model_dirs(spark, str(tmp_path), "-hpo_").collect()] == ["a-hpo_0", "m-hpo_1"]
