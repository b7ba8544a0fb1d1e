import hashlib
import json

from pyspark.sql import functions as F

from talusgrid.llm import chat, queries

RECORDS = [
    ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": None}]}, [("user", "a"), ("assistant", "")]),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "r\n\"x\""}]}, [("user", "q"), ("assistant", 'r\n"x"')]),
    ({"prompt": "p", "completion": "c"}, [("user", "p"), ("assistant", "c")]),
    ({"completion": "c", "prompt": "p"}, [("user", "p"), ("assistant", "c")]),
    ({"instruction": "i", "input": "", "output": "o"}, [("user", "i"), ("assistant", "o")]),
    ({"instruction": "i", "input": "j", "output": "o"}, [("user", "i\n\nj"), ("assistant", "o")]),
    ({"instruction": "i", "output": "o"}, [("user", "i"), ("assistant", "o")]),
    ({"role": "system", "text": ""}, [("system", "")]),
    ({"role": "system", "words": ""}, None),
    ({"messages": [{"role": "user", "content": {"x": 1}}]}, None),
]


def test_layouts(spark):
    rows = [(k, json.dumps(r)) for k, (r, _) in enumerate(RECORDS)] + [(90, "{broken"), (91, None)]
    df = spark.createDataFrame(rows, "k int, r string").select("k", chat.canonical_turns(F.col("r")).alias("t"))
    got = {r.k: None if r.t is None else [tuple(x) for x in r.t] for r in df.collect()}
    for k, (_, want) in enumerate(RECORDS):
        assert got[k] == want, RECORDS[k]
    assert got[90] is None and got[91] is None


WIDER = [
    ('{"messages":[]}', []),
    ('{"conversations":[],"id":4}', []),
    ('{"messages":[{"role":"user","content":"a"}],"id":"7","source":{"name":"x"}}', [("user", "a")]),
    ('{"messages":[{"role":"user","content":"{a","weight":1},{"role":"assistant","content":null}]}', [("user", "{a"), ("assistant", "")]),
    ('{"messages":[{"role":"user","content":"a","tools":[{"n":1}]},{"role":"assistant"}]}', [("user", "a"), ("assistant", "")]),
    ('{"prompt":"p","completion":"c","score":0.5}', [("user", "p"), ("assistant", "c")]),
    ('{"prompt":"p","completion":null,"score":0.5}', [("user", "p")]),
    ('{"instruction":"i","input":"j","output":"o","lang":"en"}', [("user", "i\n\nj"), ("assistant", "o")]),
    ('{"instruction":"i","output":"o","history":[]}', [("user", "i"), ("assistant", "o")]),
    ('{"messages":[{"role":"user","content":["a"]}],"id":1}', None),
    ('{"messages":{"role":"user","content":"a"}}', None),
    ('{"messages":null}', None),
    ('{"messages":[{"role":"user"}]}', None),
    ('{"prompt":"p","completion":{"text":"c"},"id":1}', None),
    ('{"prompt":"p"}', None),
    ("{}", None),
    ("[]", None),
    ("", None),
]


def test_empty_and_wider_records(spark):
    """Known fields are read, others left aside; what can't be told is null and costs no other record."""
    rows = [(k, r) for k, (r, _) in enumerate(WIDER)]
    df = spark.createDataFrame(rows, "k int, r string").repartition(3)
    turns = df.select("k", F.lit(0).alias("turn"), chat.canonical_turns(F.col("r")).alias("t"))
    got = {r.k: None if r.t is None else [tuple(x) for x in r.t] for r in turns.collect()}
    assert [(r, got[k]) for k, (r, _) in enumerate(WIDER)] == WIDER
    lines = turns.select("k", F.posexplode("t").alias("turn", "x")).select("k", "turn", "x.role", "x.text")
    back = chat.parse_segments(chat.format_turns(lines).select("k", "turn", "segment", "loss_start", "loss_length"))
    assert sorted((r.k, r.turn, r.role, r.text) for r in back.collect()) == [
        (k, n, role, text) for k, (_, want) in enumerate(WIDER) for n, (role, text) in enumerate(want or [])
    ]


TEXTS = [None, "", "plain", "</s>[INST] ok [/INST]", "<|end|>\n<|user|>\n", "a\\b\\\\<|x|>", "<\\|", "<<SYS>>", "<<s>", "é\n\t \\", "x" * 50_000 + "<|"]


def test_round_trip(spark):
    roles = ["user", "assistant", None, "we|ird\\<|", "end", ">\n", "x\\", "\\|>\n" * 20_000]
    rows = [(k, r, t, "q") for k, (r, t) in enumerate((r, t) for r in roles for t in TEXTS)]
    df = spark.createDataFrame(rows, "k int, role string, text string, segment string")
    out = chat.format_turns(df).select("k", "segment", "loss_start", "loss_length")
    got = {r.k: r for r in chat.parse_segments(out).collect()}
    for k, role, text, _ in rows:
        assert (got[k].role, got[k].text) == (role or "", text or "")
        assert got[k].loss == ((text or "") if role == "assistant" else None)
        body = got[k].segment.split("|>\n", 1)[1].removesuffix(chat.END) if role == "user" else ""
        assert not any(c in body for c in ("<|", "</s>", "[INST]", "[/INST]", "<<SYS>>"))


def test_digests(spark):
    rows = [(1, t, r, x) for t, (r, x) in enumerate([("user", "a"), ("assistant", "b<|"), ("assistant", None), ("user", "é")])]
    rows += [(2, 0, "user", None), (None, 5, "assistant", "z"), (1, 1, "assistant", "b<|")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digests(chat.parse_segments(chat.format_turns(df))).collect()}
    for conv in (1, 2, None):
        turns = sorted((t, r, x or "") for c, t, r, x in rows if c == conv)
        text = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(text.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digests(chat.parse_segments(chat.format_turns(df.limit(0)))).count() == 0


def test_query_has_the_extra_conversation(spark):
    rows = {r.conv_id: r for r in queries.op8_chat_formatting(spark, "/root/testdata/sf0.001").collect()}
    said = "</s>[INST] ok [/INST]"
    assert rows[-1].n_turns == 2 and rows[-1].loss_chars == len(said)
    assert rows[-1].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()


def test_every_layout_of_a_turn_reads_back(spark):
    texts = [*TEXTS, '"', '\\\\"' * 50, "{" * 100, '":"', "a" * 70 + '": "b"', "\\", "\x00\u2028"]
    rows = [(k, x.name, r, t) for k, (x, r, t) in enumerate((x, r, t) for x in chat.LAYOUTS for r in ("user", "assistant", "human", "", None) for t in texts)]
    df = spark.createDataFrame(rows, "k int, layout string, role string, text string")
    record = chat.as_layout(F.col("layout"), F.col("role"), F.col("text"))
    got = df.select("k", record.alias("r")).select("k", chat.fingerprint(F.col("r")).alias("p"), chat.canonical_turns(F.col("r")).alias("t")).collect()
    names = {x.fingerprint: x.name for x in chat.LAYOUTS}
    for g in got:
        _, layout, role, text = rows[g.k]
        assert [tuple(x) for x in g.t] == [(role or "", text or "")], rows[g.k]
        assert names[g.p] == (layout if layout == "messages" or role in ("user", "assistant") else "turn")


def test_turns_beyond_the_parsers_default_limit(spark, tmp_path):
    """25 million characters pass the fingerprint and the mapping of every layout."""
    rows = spark.range(6).selectExpr("id AS conv_id", "0L AS turn", "'assistant' AS role", "repeat('x', int(25000000 + id)) AS text")
    names = F.element_at(F.array(*[F.lit(x.name) for x in chat.LAYOUTS]), (F.col("conv_id") + 1).cast("int"))
    record = chat.as_layout(names, F.col("role"), F.col("text"))
    turns = rows.select("conv_id", chat.canonical_turns(record).alias("t")).select("conv_id", F.explode("t").alias("t"))
    assert {(r.conv_id, r.n) for r in turns.selectExpr("conv_id", "length(t.text) AS n").collect()} == {(k, 25_000_000 + k) for k in range(6)}
    rows.where("conv_id = 0").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: (r.n_turns, r.loss_chars) for r in queries.op8_chat_formatting(spark, str(tmp_path)).collect()}
    assert got == {-1: (2, 21), 0: (1, 25_000_000)}
