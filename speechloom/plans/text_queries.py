"""Scalar functions, filters and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import audio as A
from ..functions import text as X
from ..functions.audio_headers import measure
from ..operators import metrics as M
from ..operators import sequences as S
from ..operators.order import global_index
from ..sources import files
from . import inputs as I
from .inputs import duck, table
from .registry import query

_WS = r"[ \t\n\r]"


@query("clean_text", rf"""SELECT doc_id, trim(regexp_replace(lower(regexp_replace(text, '<[^>]+>', ' ', 'g')), '{_WS}+', ' ', 'g')) AS spaced,
 lower(regexp_replace(regexp_replace(text, '<[^>]+>', '', 'g'), '^{_WS}+|{_WS}+$', '', 'g')) AS dropped FROM documents""")
def clean_text(spark, d):
    return table(spark, d, "documents").select("doc_id", X.clean_text(F.col("text")).alias("spaced"), X.clean_text(F.col("text"), "drop").alias("dropped"))


@query("coalesce_text", """SELECT d.doc_id, coalesce(nullif(CASE WHEN l.quality = 0 THEN '' WHEN l.quality = 1 THEN d.source END, ''), nullif(d.lang, ''), '') AS text
 FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def coalesce_text(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return rows.select("doc_id", X.coalesce_text(F.when(F.col("quality") == 0, "").when(F.col("quality") == 1, F.col("source")), F.col("lang")).alias("text"))


@query("normalise_utterance_id", """SELECT doc_id, regexp_replace(source || '/' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.opus' ELSE '' END || CASE WHEN doc_id % 4 = 0 THEN '.opus' ELSE '' END, '\\.opus$', '') AS id,
 CAST(doc_id AS VARCHAR) AS stem FROM documents""".replace("\\\\", "\\"))
def normalise_utterance_id(spark, d):
    raw = F.concat("source", F.lit("/"), "doc_id", F.when(F.col("doc_id") % 2 == 0, ".opus").otherwise(""), F.when(F.col("doc_id") % 4 == 0, ".opus").otherwise(""))
    return table(spark, d, "documents").select("doc_id", X.normalise_utterance_id(raw).alias("id"), X.file_stem(F.concat(F.lit("/a.b/"), F.col("doc_id"), F.lit(".flac")), F.lit(0)).alias("stem"))


@query("map_split_name", duck("utts", "SELECT doc_id, CASE dataset WHEN 'ls100' THEN 'train.clean.100' WHEN 'ls360' THEN 'train.clean.360' WHEN 'ls500' THEN 'train.other.500' ELSE dataset END AS split, dataset AS slug FROM utts"))
def map_split_name(spark, d):
    rows = I.utts(spark, d).withColumn("split", X.map_split_name(F.col("dataset")))
    return rows.select("doc_id", "split", X.map_split_name(F.col("split"), back=True).alias("slug"))


@query("select_datasets", duck("utts", "SELECT doc_id, dataset FROM utts WHERE dataset IN ('mls', 'vp')"))
def select_datasets(spark, d):
    return M.select_datasets(I.utts(spark, d), ["mls", "vp"], ["ls100", "ls360", "ls500", "mls", "gs", "vp"]).select("doc_id", "dataset")


_ENCODERS = [("fine", 128, 24000, 320, [2, 2]), ("coarse", 64, 16000, 640, [2]), ("plain", 80, 16000, 160, [2, 2, 2]), ("odd", 8, 44100, 512, [])]


@query("encoder_config", """SELECT c_custkey, n.encoder, out_dim, CAST(spt AS BIGINT) AS samples_per_token, fps, CAST(floor(480000 / spt) AS BIGINT) AS max_audio_tokens, 8000 AS max_batch_tokens
 FROM (SELECT c_custkey, (['fine', 'coarse', 'plain', 'odd', 'none'])[CAST(c_custkey % 5 AS INT) + 1] AS encoder FROM customer) n
 LEFT JOIN (SELECT *, floor(CAST(hop AS DOUBLE) * 16000 * stride / rate) AS spt, CAST(rate AS DOUBLE) / hop AS fps FROM (VALUES ('fine', 128, 24000, 320, 4), ('coarse', 64, 16000, 640, 2), ('plain', 80, 16000, 160, 8), ('odd', 8, 44100, 512, 1)) e(encoder, out_dim, rate, hop, stride)) e ON n.encoder = e.encoder""".replace("8000 AS max_batch_tokens", "CASE WHEN spt IS NOT NULL THEN 8000 END AS max_batch_tokens"))
def encoder_config(spark, d):
    wanted = table(spark, d, "customer").select("c_custkey", F.element_at(F.array(*map(F.lit, ("fine", "coarse", "plain", "odd", "none"))), (F.col("c_custkey") % 5).cast("int") + 1).alias("encoder"))
    return A.encoder_config(wanted, A.encoders(spark, _ENCODERS)).select("c_custkey", "encoder", "out_dim", "samples_per_token", "fps", "max_audio_tokens", "max_batch_tokens")


@query("estimate_tokens", duck("utts", """SELECT doc_id, CAST(s AS BIGINT) AS samples, CAST(floor(s / 1280) + 256 AS BIGINT) AS tokens, CAST(ceil(n_words / 4) + 64 + 6 AS BIGINT) AS by_frames
 FROM (SELECT *, least(coalesce(CASE WHEN doc_id % 3 <> 0 THEN floor(greatest(audio_ms, 0) * 24 * 16000 / 24000) END, floor(length(transcript) * 16000 / 14)), 480000) AS s FROM utts)"""))
def estimate_tokens(spark, d):
    frames = F.when(F.col("doc_id") % 3 != 0, F.greatest(F.col("audio_ms"), F.lit(0)) * 24)
    rows = I.utts(spark, d).withColumn("samples", A.estimate_samples(frames, F.lit(24000), F.length("transcript"), 480000))
    return rows.select("doc_id", "samples", A.estimate_tokens(F.col("samples"), F.lit(1280), 256).alias("tokens"), A.estimate_tokens_of_frames(F.col("n_words"), 4, 64).alias("by_frames"))


@query("audio_headers", duck("utts", """SELECT doc_id, CASE WHEN ms > 0 THEN (['flac', 'wav', 'opus', NULL])[doc_id % 4 + 1] END AS kind, CASE WHEN ms > 0 THEN CAST(r AS BIGINT) END AS rate, CASE WHEN ms > 0 THEN CAST(([1, 2, 2, NULL])[doc_id % 4 + 1] AS INTEGER) END AS channels, CASE WHEN ms > 0 THEN CAST(ms * r // 1000 AS BIGINT) END AS frames,
 CAST(least(coalesce(CASE WHEN ms > 0 THEN ms * r // 1000 * 16000 // r END, length(transcript) * 16000 // 14), 480000) AS BIGINT) AS samples
 FROM (SELECT *, ([24000, 44000, 48000, NULL])[doc_id % 4 + 1] AS r FROM (SELECT *, greatest(audio_ms, 0) AS ms FROM utts))"""))
def audio_headers(spark, d):
    return measure(I.audio_files(spark, d), "content", F.col("transcript"), 480_000).select("doc_id", "header.kind", "header.rate", "header.channels", "header.frames", "samples")


@query("frame_count", duck("utts", """SELECT doc_id, CAST(f AS BIGINT) AS valid, CAST(len(list_filter(range(1, 101), lambda i: i <= f)) AS BIGINT) AS set_bits
 FROM (SELECT doc_id, least(ceil(floor(greatest(audio_ms, 0) * 16 * 24000 / 16000) / 320), 100) AS f FROM utts)"""))
def frame_count(spark, d):
    rows = I.utts(spark, d).withColumn("valid", A.frame_count(F.greatest(F.col("audio_ms"), F.lit(0)) * 16, F.lit(24000), F.lit(320), F.lit(100)))
    return rows.select("doc_id", "valid", F.size(F.filter(A.frame_mask(F.col("valid"), F.lit(100)), lambda b: b)).cast("long").alias("set_bits"))


@query("projected_len", duck("utts", """SELECT doc_id, CAST(ceil(n_words / 4) AS BIGINT) AS a, CAST(greatest(1, floor(n_words / 12)) AS BIGINT) AS b, CAST(floor(n_words / 10) AS BIGINT) AS c, CAST(ceil(ceil(n_words / 2) / 2) AS BIGINT) AS e FROM utts"""))
def projected_len(spark, d):
    n = F.col("n_words")
    return I.utts(spark, d).select("doc_id", A.projected_len(n, "ceil", 4).alias("a"), A.projected_len(n, "floor_min1", 12).alias("b"), A.projected_len(n, "floor", 10).alias("c"), A.projected_len(n, "two_convs").alias("e"))


@query("limit_audio", "SELECT vec_id, CAST(least(len(embedding), 48) AS BIGINT) AS n, CAST(len(embedding) <= 48 AS BOOLEAN) AS kept FROM embeddings")
def limit_audio(spark, d):
    rows = table(spark, d, "embeddings")
    cut = A.limit_audio(rows, "embedding", 48)
    kept = A.limit_audio(rows, "embedding", 48, "drop").select("vec_id", F.lit(True).alias("k"))
    return cut.join(kept, "vec_id", "left").select("vec_id", F.size("embedding").cast("long").alias("n"), F.coalesce("k", F.lit(False)).alias("kept"))


@query("downmix", "SELECT vec_id, i, CAST(CAST(embedding[CAST(i AS INT)] + embedding[CAST(i + 32 AS INT)] AS FLOAT) / 2 AS FLOAT) AS mono FROM (SELECT vec_id, embedding, CAST(unnest(range(1, 33)) AS BIGINT) AS i FROM embeddings)")
def downmix(spark, d):
    halves = F.array(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32))
    rows = table(spark, d, "embeddings").select("vec_id", F.posexplode(A.downmix(halves)).alias("i", "mono"))
    return rows.select("vec_id", (F.col("i") + 1).cast("long").alias("i"), "mono")


@query("hash_split", duck("utts", "SELECT doc_id, CAST(('0x' || md5(utterance_id)[1:2])::INT & 1 AS INTEGER) AS half FROM utts"))
def hash_split(spark, d):
    return I.utts(spark, d).select("doc_id", X.hash_split(F.col("utterance_id")).alias("half"))


@query("usable_samples", duck("utts", """SELECT CASE WHEN audio_ms * 25 // 1000 <= 0 THEN 'no_frames' WHEN doc_id % 37 = 0 THEN 'no_features' WHEN n_words = 0 THEN 'no_text' WHEN n_words > 1000 THEN 'too_long' ELSE 'ok' END AS reason, count(*) AS n FROM utts GROUP BY 1"""))
def usable_samples(spark, d):
    rows = I.utts(spark, d).select("doc_id", F.floor(F.col("audio_ms") * 25 / 1000).alias("feat_len"), F.when(F.col("doc_id") % 37 == 0, 0).otherwise(8).alias("n_features"), F.col("n_words").alias("n_text"), F.col("n_words").alias("len"))
    return S.usable_samples(rows, cutoff=1000)[1]


@query("head_per_group", duck("utts", "SELECT dataset, doc_id FROM utts QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY doc_id) <= 5"))
def head_per_group(spark, d):
    return M.head_per_group(I.utts(spark, d), 5, "dataset", "doc_id").select("dataset", "doc_id")


@query("evenly_spaced", "SELECT o_orderkey, i AS idx FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders) WHERE i % greatest(1, n // 40) = 0 AND i // greatest(1, n // 40) < 40")
def evenly_spaced(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey")
    return M.evenly_spaced(global_index(orders, "o_orderkey"), 40, orders.count()).select("o_orderkey", "idx")


@query("sample_rows", "SELECT o_orderkey, o_custkey FROM orders ORDER BY md5('7:' || o_orderkey), o_orderkey LIMIT 100")
def sample_rows(spark, d):
    return M.sample_rows(table(spark, d, "orders").select("o_orderkey", "o_custkey"), 100, 7, "o_orderkey", ordered=True, portable=True)


@query("model_tag", r"""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN '_qwen3_0.6b' WHEN 2 THEN '_qwen2.5_7b' ELSE '' END AS tag FROM part""")
def model_tag(spark, d):
    name = F.element_at(F.array(*map(F.lit, ("Org/Base-1B", "Org/Qwen3-0.6B", "Org/Qwen2.5-7B-Instruct", "unnamed"))), (F.col("p_partkey") % 4).cast("int") + 1)
    return table(spark, d, "part").select("p_partkey", X.model_tag(name, "Org/Base-1B").alias("tag"))


@query("char_targets", r"""SELECT doc_id, CAST(len(t) AS BIGINT) AS n, CAST(list_sum(list_transform(t, lambda x, i: CAST(x * i AS BIGINT))) AS BIGINT) AS digest FROM (SELECT doc_id, CASE WHEN s = '' THEN [27] ELSE list_transform(string_split(s, ''), lambda c: CASE WHEN c = ' ' THEN 27 ELSE ascii(c) - 96 END) END AS t
 FROM (SELECT doc_id, regexp_replace(lower(text), '[^a-z ]', '', 'g') AS s FROM documents))""")
def char_targets(spark, d):
    rows = table(spark, d, "documents").select("doc_id", X.char_targets(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n"), F.aggregate(F.transform("t", lambda x, i: x.cast("long") * (i + 1)), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("digest"))


@query("round_words", duck("words", "SELECT doc_id, pos, round_even(st_ms / 1000, 4) AS \"start\", CASE WHEN pos % 5 = 0 THEN 0.0 ELSE round_even(score_milli / 1000, 4) END AS score FROM words"))
def round_words(spark, d):
    w = F.array(F.struct(F.concat(F.lit(" "), F.col("word"), F.lit(" ")).alias("word"), (F.col("st_ms") / 1000).alias("start"), (F.col("en_ms") / 1000).alias("end"), F.when(F.col("pos") % 5 != 0, F.col("score_milli") / 1000).alias("score")))
    return I.words(spark, d).select("doc_id", "pos", X.round_words(w)[0].alias("w")).select("doc_id", "pos", "w.start", "w.score")


@query("concatenate_and_subset", "SELECT doc_id AS id, lang AS tag FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) UNION ALL SELECT vec_id, NULL FROM embeddings")
def concatenate_and_subset(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_semi").select(F.col("doc_id").alias("id"), F.col("lang").alias("tag"))
    return S.concatenate([docs, table(spark, d, "embeddings").select(F.col("vec_id").alias("id"))])


@query("read_corpora", """SELECT 'docs' AS dataset, CAST(doc_id AS VARCHAR) AS utterance_id, coalesce(nullif(source, ''), '') AS text FROM documents
 UNION ALL SELECT 'chats', conv_id || '-' || turn, coalesce(nullif(text, ''), nullif(role, ''), '') FROM conversations UNION ALL SELECT 'bench', CAST(item_id AS VARCHAR), coalesce(text, '') FROM benchmark""")
def read_corpora(spark, d):
    chats = table(spark, d, "conversations").withColumn("key", F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"), F.lit(".opus")))
    return files.read_corpora({"docs": (table(spark, d, "documents"), "doc_id", ["source"]), "chats": (chats, "key", ["text", "role"]), "bench": (table(spark, d, "benchmark"), "item_id", ["text"])}).drop("audio")


@query("keep_existing_files", "SELECT page_id, url FROM pages WHERE url IN (SELECT url FROM pages WHERE page_id % 3 = 0)")
def keep_existing_files(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url")
    return files.keep_existing_files(pages, pages.filter("page_id % 3 = 0"), "url")


@query("pending_only", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)")
def pending_only(spark, d):
    return files.pending_only(table(spark, d, "orders").select("o_orderkey"), table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", F.col("l_quantity") > 40)


@query("choose_layout", """SELECT dataset, arg_min(path, r) AS path, arg_min(layout, r) AS layout FROM (SELECT *, (suffix <> '_big')::INT * 1000000 + (CASE layout WHEN 'sentence' THEN 1 WHEN 'sentence_only' THEN 2 WHEN 'interleaved' THEN 3 ELSE 4 END) * 100000 + (CASE form WHEN 'packed' THEN 1 WHEN 'sharded' THEN 2 ELSE 3 END) * 10000 + s AS r FROM
 (SELECT s_suppkey AS s, 'd' || s_nationkey AS dataset, (['sentence', 'sentence_only', 'interleaved', 'plain'])[CAST(s_suppkey % 4 AS INT) + 1] AS layout, CASE WHEN s_suppkey % 3 = 0 THEN '_big' ELSE '' END AS suffix, (['packed', 'sharded', 'single'])[CAST(s_suppkey % 7 % 3 AS INT) + 1] AS form, lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS path, s_suppkey % 5 AS n_rows FROM supplier) WHERE n_rows > 0) GROUP BY dataset""")
def choose_layout(spark, d):
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), n.cast("int") + 1)
    k = F.col("s_suppkey")
    catalog = table(spark, d, "supplier").select(F.concat(F.lit("d"), "s_nationkey").alias("dataset"), pick(files.LAYOUTS, k % 4).alias("layout"), F.when(k % 3 == 0, "_big").otherwise("").alias("suffix"), pick(("packed", "sharded", "single"), k % 7 % 3).alias("form"), F.lpad(k.cast("string"), 9, "0").alias("path"), (k % 5).alias("n_rows"))
    return files.choose_layout(catalog, "_big")
