"""One query for each operator of this subpackage, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, fim, images, language, lattice, mixing, near, packing, quality, sharding, substrings, trie, warc
from .common import SPACE, table

#: Where the vocabularies of public tokenizers are.
WORD_VOCABULARY = "word_bpe_49k.json"
PIECE_VOCABULARY = "piece_bpe_32k.model"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pieces = packing.pack(docs, vocabulary(WORD_VOCABULARY))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    network, classes = language.fit(docs.where(~held))
    return language.identify(docs.select("doc_id", "text", held.alias("held_out")), network, classes).select(
        "doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score")
    )


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame(
        [(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string"
    )
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    # the table has one layout; its rows are dealt out to all that sources write
    names = F.array(*[F.lit(layout.name) for layout in chat.LAYOUTS])
    name = F.get(names, F.pmod(F.xxhash64("conv_id", "turn"), F.lit(len(chat.LAYOUTS))).cast("int"))
    records = rows.unionByName(extra).select("conv_id", "turn", chat.as_layout(name, F.col("role"), F.col("text")).alias("record"))
    records = records.withColumn("print", chat.fingerprint(F.col("record")))
    turns = records.select(
        "conv_id", "turn", chat.canonical_turns(F.col("record"), print_=F.col("print")).alias("turns")
    )
    # a record whose layout can't be told, such as one too long to parse, is not dropped in silence
    lost = F.raise_error(F.format_string("conversation %s, turn %s: its layout can't be told", "conv_id", "turn"))
    turns = turns.select("conv_id", "turn", F.explode(F.coalesce("turns", lost)).alias("t"))
    formatted = table(
        chat.format_turns(turns.select("conv_id", "turn", "t.role", "t.text")).select(
            "conv_id", "turn", "segment", "loss_start", "loss_length"
        ),
        "chat",
    )
    return chat.digests(chat.parse_segments(formatted))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality.apply_rules(docs).select(
        "doc_id",
        F.col("q_n_words").alias("n_words"),
        F.col("q_word_chars").alias("word_chars"),
        F.col("q_n_symbols").alias("n_symbols"),
        F.col("q_n_dup_lines").alias("n_dup_lines"),
        F.col("q_n_repeat_words").alias("n_repeat_words"),
        F.col("q_base_failed").alias("base_failed"),
        F.col("q_kept").alias("kept"),
    )


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "source", "mix_pass", "mix_block", "mix_rank", "mix_tokens")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    folder = warc.archive_folder(spark)
    records = warc.read_packages(warc.write_packages(pages, folder, least_bytes=0), folder)
    return records.select(
        "page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to"
    )


def op4_lattice_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return lattice.score_documents(docs, vocabulary(PIECE_VOCABULARY))


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return images.copies(images.draw(vectors, "vec_id", "embedding"), "vec_id", "image")


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near.similar(docs).select(
        near.real_id("_id").alias("doc_id"), near.real_id("class_id").alias("class_id"), "n_links"
    )


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    words = F.filter(F.split(F.coalesce("rs_text", F.lit("")), SPACE), lambda w: w != "")
    return substrings.remove_repeats(docs).select(
        "doc_id",
        F.col("rs_words").alias("n_words"),
        F.col("rs_removed").alias("n_removed"),
        F.sha2(F.concat_ws(" ", words), 256).alias("kept_sha256"),
    )


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return fim.transform(docs).select(
        "doc_id",
        F.col("fim_n").alias("n"),
        F.col("fim_form").alias("form"),
        F.col("fim_start").alias("prefix_chars"),
        (F.col("fim_stop") - F.col("fim_start")).alias("middle_chars"),
        F.sha2("fim_text", 256).alias("output_sha256"),
        F.sha2(fim.restore(F.col("fim_text"), F.col("fim_form")), 256).alias("restored_sha256"),
    )


def rebuilt(turns: DataFrame, every: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns are another's, as ``trie.build`` takes them, and all their ids.

    A conversation's first h turns, h drawn by its id and below ``most``, are
    those of the conversation at the multiple of ``every`` before it. At most
    ``most`` turns of a conversation are copied, to at most 2 ``every`` others.
    A null id takes no other's turns.
    """
    own = F.col("_c")
    drawn = F.crc32(trie.real_id("_c").cast("string").cast("binary")) % most
    convs = turns.select(own).distinct().select(
        own, F.coalesce(drawn, F.lit(0)).alias("_h"), (own - own % every).alias("_base")
    )
    first = turns.where(F.col("_at") < most).withColumnRenamed("_c", "_base")
    heads = (
        convs.where(own != trie.NO_ID)
        .join(first, "_base")
        .where("_at < _h")
        .select("_c", (F.col("_at") + 1).alias("depth"), "_key", "_bytes")
    )
    taken = heads.groupBy("_c").agg(F.count("*").alias("_taken"))
    moved = convs.join(taken, "_c", "left").select(
        "_c", "_h", (F.coalesce("_taken", F.lit(0)) - F.col("_h") + 1).alias("_move")
    )
    tails = turns.join(moved, "_c").where("_at >= _h").select(
        "_c", (F.col("_at") + F.col("_move")).alias("depth"), "_key", "_bytes"
    )
    return heads.unionByName(tails), convs.select("_c")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    turns = table(trie.in_order(trie.turn_keys(rows)), "turns")
    return trie.build(*rebuilt(turns))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    data = F.coalesce("text", F.lit("")).cast("binary")
    docs = docs.select(
        "doc_id", (F.octet_length(data) + 8).cast("long").alias("size"), F.crc32(data).alias("text_crc32")
    )
    placed = sharding.place(docs.withColumn("law", F.lit("key")), sharding.layout())
    grown = sharding.place(placed, sharding.layout(sharding.BASE_SHARDS + 1), column="grown_shard")
    return sharding.slots(grown, ["doc_id", "text_crc32", "size"])


_STOP = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)
OP9_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT r, doc_id, text,
    list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g') <> '') AS lines
  FROM d
), g AS (
  SELECT r, p, words[p] || ' ' || words[p + 1] || ' ' || words[p + 2] AS gram
  FROM (SELECT r, words, unnest(generate_series(1, len(words) - 2)) AS p FROM w)
), c AS (
  SELECT r, p, count(*) OVER (PARTITION BY r, gram) AS n FROM g
), m AS (
  SELECT r, least(3, coalesce(lead(p) OVER (PARTITION BY r ORDER BY p) - p, 3)) AS covered FROM c WHERE n > 1
), rep AS (
  SELECT r, sum(covered)::BIGINT AS n FROM m GROUP BY r
), s AS (
  SELECT doc_id, len(words)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    len(lines) AS n_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
    len(list_filter(words, lambda x: lower(x) IN ({_STOP})))::DOUBLE AS n_stop
  FROM w LEFT JOIN rep USING (r)
), j AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed
  AND coalesce(word_chars / nullif(n_words, 0)::DOUBLE BETWEEN 2.0 AND 15.0, false)
  AND coalesce(n_symbols / nullif(n_words, 0)::DOUBLE <= 0.2, false)
  AND coalesce(n_stop / nullif(n_words, 0) >= 0.005, false)
  AND coalesce(n_dup_lines / nullif(n_lines, 0)::DOUBLE <= 0.5, false) AS kept
FROM j
"""

QUERIES = {
    "op1_packing": op1_packing,
    "op2_mixing": op2_mixing,
    "op3_warc": op3_warc,
    "op4_lattice_likelihood": op4_lattice_likelihood,
    "op5_media_columns": op5_media_columns,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_language_id": op7_language_id,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_quality_rules": op9_quality_rules,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_sharding": op13_sharding,
}
#: Oracle for the WARC query: what the archives must say, from the pages.
OP3_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha1(body) AS hex FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first FROM d)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + list_sum(list_transform(range(5), lambda j:
      ((strpos('0123456789abcdef', substr(hex, ((5 * i + j) // 4 + 1)::INTEGER, 1)) - 1)
        // power(2, 3 - (5 * i + j) % 4)::INTEGER % 2) * power(2, 4 - j)::INTEGER))::INTEGER, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""

OP8_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), f AS (
  SELECT *, '<|' || role || '|>' || chr(10)
    || regexp_replace(replace(text, '\', '\\'),
      '(<)(\||/?s>|</?SYS>>|start_of_turn>|end_of_turn>)|(\[)(/?INST\])', '\1\3\\\2\4', 'g')
    || '<|end|>' || chr(10) AS segment
  FROM c
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(segment))::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""

#: The CRC-32 of a text's UTF-8 in SQL: its table by recursion, then a fold over the bytes.
CRC_TABLE = """
bit(n, k, v) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL SELECT n, k + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM bit WHERE k < 8
), steps AS (SELECT list(v ORDER BY n) AS t FROM bit WHERE k = 8)
"""


def _crc(text: str) -> str:
    digits = f"list_filter(string_split(regexp_replace(hex(encode({text})), '(..)', '\\1,', 'g'), ','), lambda x: x <> '')"
    return (
        f"xor(list_reduce(list_transform({digits}, lambda x: ('0x' || x)::BIGINT),"
        " lambda a, b: xor(a // 256, t[1 + xor(a % 256, b)]), 4294967295), 4294967295)::BIGINT"
    )


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS hex,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units
  FROM documents
), h AS (
  SELECT *, len(units)::BIGINT AS n,
    list_transform(range(4), lambda k: ('0x' || substr(hex, (8 * k + 1)::INTEGER, 8))::BIGINT) AS draw FROM d
), c AS (
  SELECT *, least(draw[1] % (n + 1), draw[2] % (n + 1)) AS low, greatest(draw[1] % (n + 1), draw[2] % (n + 1)) AS high,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR draw[3] % 100 >= 50
      THEN 'plain' WHEN draw[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h
), p AS (
  SELECT *, array_to_string(units[1:low], '') AS prefix, array_to_string(units[low + 1:high], '') AS middle,
    array_to_string(units[high + 1:n], '') AS suffix FROM c
)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text
    WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""

#: Descendants by brute force: each node's ancestors lie on the path of its least member.
OP12_SQL = f"""
WITH RECURSIVE {CRC_TABLE}, o AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id
    ORDER BY turn NULLS FIRST, coalesce(role, ''),
      sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS place
  FROM conversations
), h AS (
  SELECT c, c - c % 5 AS base, {_crc("c::VARCHAR")} % 9 AS h FROM (SELECT DISTINCT c FROM o), steps
), k AS (
  SELECT h.c, base, h, count(o.c) AS held FROM h LEFT JOIN o ON o.c = base GROUP BY ALL
), r AS (
  SELECT k.c, place + 1 AS d, role, text FROM k JOIN o ON o.c = base AND place < h
  UNION ALL SELECT k.c, least(h, held) + place - h + 1, role, text FROM k JOIN o ON o.c = k.c AND place >= h
), p AS (
  SELECT c, d, text, list({{'role': role, 'text': text}}) OVER (PARTITION BY c ORDER BY d) AS path FROM r
  UNION ALL SELECT c, 0, '', [] FROM k
), n AS (
  SELECT path, d, min(c) AS c, count(*) AS n_convs, any_value(strlen(text)) AS bytes FROM p GROUP BY path, d
), q AS (
  SELECT path[:d - 1] AS path, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL
), s AS (
  SELECT above.path, sum((n.n_convs - 1) * n.bytes) AS saved, count(*) FILTER (q.path IS NULL) AS n_leaves
  FROM n LEFT JOIN q ON q.path = n.path JOIN p AS above ON above.c = n.c AND above.d <= n.d GROUP BY ALL
), e AS (
  SELECT path, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS ends
  FROM (SELECT c, arg_max(path, d) AS path FROM p GROUP BY c) GROUP BY path
)
SELECT n.c AS conv_id, n.d::BIGINT AS depth, up.c AS parent_conv_id, n.n_convs::BIGINT AS n_convs,
  coalesce(n_children, 0)::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens,
  coalesce(ends, sha256('')) AS ends_sha256
FROM n JOIN s ON s.path = n.path LEFT JOIN q ON q.path = n.path LEFT JOIN e ON e.path = n.path
LEFT JOIN n AS up ON n.d > 0 AND up.path = n.path[:n.d - 1]
"""


def _op13_sql() -> str:
    def drawn(name: str) -> str:
        return f"-ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || {name}), 1, 13))::BIGINT + 0.5) / 4503599627370496) / w"

    def chosen(as_: str, tree: list[sharding.Shard]) -> str:
        leaves = ", ".join(f"('{s.region}', '{s.rack}', {s.shard}, {s.weight})" for s in tree)
        return f"""{as_} AS (SELECT * FROM (VALUES {leaves}) AS v(region, rack, shard, w)),
{as_}1 AS (SELECT r, doc_id, arg_min(region, {drawn("region")}) AS region
  FROM d, (SELECT region, sum(w) AS w FROM {as_} GROUP BY ALL) GROUP BY ALL),
{as_}2 AS (SELECT r, doc_id, region, arg_min(rack, {drawn("region || '/' || rack")}) AS rack
  FROM {as_}1 JOIN (SELECT region, rack, sum(w) AS w FROM {as_} GROUP BY ALL) USING (region) GROUP BY ALL),
{as_}3 AS (SELECT r, arg_min(shard, {drawn("region || '/' || rack || '/' || shard")}) AS shard
  FROM {as_}2 JOIN {as_} USING (region, rack) GROUP BY ALL)"""

    return f"""
WITH RECURSIVE {CRC_TABLE}, d AS (
  SELECT row_number() OVER () AS r, doc_id, strlen(coalesce(text, ''))::BIGINT + 8 AS size,
    {_crc("coalesce(text, '')")} AS text_crc32 FROM documents, steps
), {chosen("now", sharding.layout())}, {chosen("later", sharding.layout(sharding.BASE_SHARDS + 1))}
SELECT doc_id, size, text_crc32, 'key' AS law, now3.shard AS shard, later3.shard AS grown_shard,
  row_number() OVER (PARTITION BY now3.shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot
FROM d JOIN now3 USING (r) JOIN later3 USING (r)
"""


ORACLE_SQL = {
    "op11_fill_in_middle": OP11_SQL,
    "op12_prefix_trie": OP12_SQL,
    "op13_sharding": _op13_sql(),
    "op8_chat_formatting": OP8_SQL,
    "op3_warc": OP3_SQL,
    "op9_quality_rules": OP9_SQL,
}
