"""Source divergence, Hilbert shards and conversation repair against brute force."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from speechloom.llm import perfect_hash as ph
from speechloom.llm import source_divergence as sd
from speechloom.llm.conversation_repair import Conversations, align_turns, damage
from speechloom.llm.hilbert_shards import curve_table, file_ranges, hilbert_index, hilbert_shards, level_cuts, level_of, may_hold, write_shards
from speechloom.llm.source_divergence import source_divergence

from .fixtures import SCHEMA, documents


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA).repartition(3).cache()


# Perfect hashes


def shards_of(keys, shards):
    langs = sorted({k[0] for k in keys})
    of, terms = np.array([langs.index(k[0]) for k in keys]), pa.array([k[1] for k in keys])
    number = ph.shard_of(ph.key_hashes(of, pa.array(langs), terms), shards)
    pick = lambda s, i: pa.array([keys[j][i] for j in np.flatnonzero(number == s)], pa.string())
    return of, pa.array(langs), terms, number, [ph.build_shard(s, pick(s, 0), pick(s, 1)) for s in range(shards)]


@pytest.mark.parametrize("levels", [24, 1])
def test_perfect_hashes(monkeypatch, levels):
    """Every key has a slot of its own, no other key has any; with one level some keys must be listed by name."""
    monkeypatch.setattr(ph, "LEVELS", levels)
    rng = random.Random(1)
    keys = sorted({(rng.choice(["en", "de", "", "l\0x"]), f"t{rng.randrange(9000)}") for _ in range(5000)})
    of, langs, terms, number, tables = shards_of(keys, 5)
    assert (sum(t["spare"][0].as_py() for t in tables) > 0) == (levels == 1)
    for part in (tables, tables[1:3]):
        found = ph.Shards(pa.concat_tables(part), 5)
        slots = found.find(of, langs, terms)
        mine = np.isin(number, [t["shard"][0].as_py() for t in part])
        assert (slots[~mine] == -1).all() and sorted(slots[mine].tolist()) == list(range(int(mine.sum())))
        assert all((found.langs[int(found.lang_of[s])].as_py(), found.terms[int(s)].as_py()) == keys[i] for i, s in enumerate(slots.tolist()) if s >= 0)
    absent = ph.Shards(pa.concat_tables(tables), 5).find(np.array([0, 1, 1]), pa.array(["en", "xx"]), pa.array(["none", "t1", "none"]))
    assert absent.tolist() == [-1, -1, -1]


def test_no_keys():
    nothing = ph.build_shard(0, pa.array([], pa.string()), pa.array([], pa.string()))
    for rows in (nothing, nothing.slice(0, 0)):
        assert ph.Shards(rows, 1).find(np.array([0]), pa.array(["en"]), pa.array(["a"])).tolist() == [-1]


# Source divergence


def brute_divergence(rows, least=3, top=200):
    read = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c < "\x80" else c for c in text or ""))) for text, lang, source in rows]
    out = []
    for lang in {r[0] for r in read}:
        mine = [(s, ts) for l, s, ts in read if l == lang]
        documents_of = collections.Counter(t for _, ts in mine for t in set(ts))
        kept = sorted((t for t, n in documents_of.items() if n >= least), key=str.encode)
        counts = {s: collections.Counter() for s, _ in mine}
        for s, ts in mine:
            counts[s].update(t for t in ts if documents_of[t] >= least)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}  # noqa: B023, E731
        p, q = {s: share(c) for s, c in counts.items()}, share(sum(counts.values(), collections.Counter()))
        for s in counts:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in counts if o != s]
            terms = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(ranked) if part == "pair" or i < top]
    return sorted(out)


def texts_of_sources(seed=3, n=120):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang, source = rng.choice(["en", "en", "de", "fr", None]), rng.choice(["hot", "hot", "s1", "s2", "Ä", None])
        own = [f"{rng.choice(['Word', 'wörd', 'x', 'ÉÉ', '😀', 'I'])}{'abcdefgh'[rng.randrange(8)]}" for _ in range(rng.randrange(0, 60))]
        rows.append((rng.choice([" ", "\n", "7", "-", "\x00"]).join(own), lang, source))
    rows += [(None, "en", "s1"), ("", "xx", "lonely"), (None, None, None), ("7 8 9", "yy", "a"), ("", "yy", "b"), ("zz", "yy", "b")]
    return rows + rows[:5] + [(" ".join(f"w{chr(97 + i % 26)}" for i in range(30_000)), "en", "s1"), ("y" * 50_000, "en", "s1")]


@pytest.mark.parametrize(("shard_terms", "round_bytes", "slice_bytes"), [(4096, 48 << 20, 6 << 20), (5, 200, 3000), (40, 1, 500)])
def test_divergence(spark, monkeypatch, shard_terms, round_bytes, slice_bytes):
    """Any size of shards, rounds and slices gives the same result; long texts are cut in pieces, one term is longer than any."""
    monkeypatch.setattr(sd, "SLICE_BYTES", slice_bytes)
    rows = texts_of_sources()
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "text string, lang string, source string, term string, shard int").repartition(3)
    got = source_divergence(df, top=7, shard_terms=shard_terms, round_bytes=round_bytes)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute_divergence(rows, top=7)


def test_counts_leave_in_bundles(spark):
    """Twice the shards are no more rows: a part of the input sends some a bundle, not one a shard."""
    rng = random.Random(5)
    rows = [("l", "s", " ".join(f"t{chr(97 + x % 26)}{chr(97 + x // 26 % 26)}{chr(97 + x // 676)}" for x in rng.sample(range(6000), 4000))) for _ in range(6)]
    df = spark.createDataFrame(rows, "lang string, source string, text string").coalesce(1)
    kept = sd.frequent_terms(df)
    made = []
    for shards in (200, 400):
        tables = sd.hash_shards(kept, shards).toArrow()
        made.append(sd.count_slots(df, tables, shards).filter("shard >= 0").count())
    assert max(made) <= sd.BUNDLES + 1 and abs(made[0] - made[1]) <= 1 + sd.BUNDLES // 2
    got = source_divergence(df, top=7, shard_terms=15)
    assert sorted(map(tuple, got.collect())) == brute_divergence([(text, lang, source) for lang, source, text in rows], top=7)


def test_divergence_of_documents(docs):
    rows = [(r.text, r.lang, r.source) for r in docs.collect()]
    assert sorted(map(tuple, source_divergence(docs).collect())) == brute_divergence(rows)


def test_divergence_of_nothing(docs):
    assert source_divergence(docs.limit(0)).collect() == []


def test_shares():
    rng = random.Random(2)
    for _ in range(200):
        total = rng.choice([0, 7, 10**6, 10**13])
        count, terms = rng.randrange(total + 1), rng.randrange(1, 10**6)
        assert sd.shares(np.array([count]), np.array(total), terms)[0] == 1 + 10**9 * (count + 1) // (total + terms)


# Hilbert shards


@pytest.mark.parametrize(("n", "bits"), [(1, 5), (2, 4), (3, 3), (4, 2)])
def test_curve(spark, n, bits):
    """The curve visits every cell once, and consecutive cells are neighbours."""
    cells = list(itertools.product(range(1 << bits), repeat=n))
    df = spark.createDataFrame(cells, ", ".join(f"c{j} int" for j in range(n)))
    walked = sorted((r.h, tuple(r)[:n]) for r in df.withColumn("h", hilbert_index([F.col(f"c{j}") for j in range(n)], bits)).collect())
    assert [h for h, _ in walked] == list(range(len(cells)))
    assert all(sum(abs(a - b) for a, b in zip(x, y, strict=True)) == 1 for (_, x), (_, y) in itertools.pairwise(walked))
    assert len(curve_table(n)) == n << 2 * n


def test_levels(spark):
    values = [None] * 10 + ["a"] * 50 + ["b"] * 5 + ["ü"] * 35
    df = spark.createDataFrame([(v,) for v in values], "v string")
    cuts = level_cuts(df, "v", bits=3)
    assert cuts == [(0, "a"), (4, "b"), (5, "ü")]  # 10, 60 and 65 of 100 rows lie before them
    seen = spark.createDataFrame([(v,) for v in [None, "", "a", "aa", "b", "c", "ü", "ÿ"]], "v string").select(level_of(F.col("v"), cuts).alias("l")).collect()
    assert [r.l for r in seen] == [0, 0, 0, 0, 4, 4, 5, 5]
    assert level_cuts(df.limit(0), "v") == []


@pytest.mark.parametrize("law", ["rows", "bytes"])
@pytest.mark.parametrize("n", [1, 7, 64])
def test_hilbert_shards(docs, law, n):
    rows = docs.withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)) + 1).withColumn("shard", F.lit("clash"))
    got = hilbert_shards(rows, ["lang", "source", "size"], n, ["doc_id", "text"], law=law, size="size")
    assert got.columns == [*docs.columns, "size", "hilbert", "shard", "slot"]
    got = got.collect()
    assert collections.Counter((r.doc_id, r.text) for r in got) == collections.Counter((r.doc_id, r.text) for r in docs.collect())
    by_shard = collections.defaultdict(list)
    for r in got:
        by_shard[r.shard].append(r)
    assert all(sorted(r.slot for r in rs) == list(range(len(rs))) for rs in by_shard.values())
    order = [r.hilbert for s in sorted(by_shard) for r in sorted(by_shard[s], key=lambda r: r.slot)]
    assert order == sorted(order) and set(by_shard) <= set(range(n))
    if law == "rows":
        sizes = [len(by_shard[s]) for s in range(n)]
        assert max(sizes) - min(sizes) <= 1
    else:
        total, largest = sum(r["size"] for r in got), max(r["size"] for r in got)
        assert all(abs(sum(r["size"] for r in by_shard[s]) - total / n) <= largest for s in range(n))


def test_hilbert_files_are_pruned(spark, tmp_path):
    """A range of any of three dimensions reads a part of the files, where an order by one of them would read all for another."""
    rng = random.Random(4)
    df = spark.createDataFrame([(i, rng.randrange(1000), rng.randrange(1000), rng.randrange(1000)) for i in range(6000)], "id int, a int, b int, c int")
    write_shards(hilbert_shards(df, ["a", "b", "c"], 8, ["id"]), str(tmp_path / "curve"), files=64)
    written = spark.read.parquet(str(tmp_path / "curve"))
    assert written.count() == 6000
    ranges = file_ranges(written, ["a", "b", "c"]).cache()
    files = ranges.count()
    assert files >= 32
    for dim in "abc":
        chosen = may_hold(ranges, {dim: (100, 150)})
        assert chosen.count() <= 0.6 * files
        paths = [r.path for r in chosen.collect()]
        assert spark.read.parquet(*paths).filter(F.col(dim).between(100, 150)).count() == df.filter(F.col(dim).between(100, 150)).count()
    assert may_hold(ranges, {"a": (100, 150), "b": (100, 150), "c": (100, 150)}).count() <= 0.1 * files


def test_shards_of_nothing(docs):
    empty = docs.limit(0).withColumn("size", F.lit(1))
    for law in ("rows", "bytes"):
        assert hilbert_shards(empty, ["lang", "size"], 8, ["doc_id"], law=law, size="size").collect() == []
    with pytest.raises(ValueError):
        hilbert_shards(docs, ["lang"], 8, ["doc_id"], law="key")


# Conversation repair


def brute_repair(turns):
    """The least (cost, audit) over all states of the grammar, any insertions between turns."""
    best = {"E": (0, "")}

    def inserted(found):
        for _ in range(3):
            more = dict(found)
            for state, (cost, audit) in found.items():
                to, way = "A" if state == "U" else "U", (cost + 2, audit + "I")
                more[to] = min(more.get(to, way), way)
            found = more
        return found

    for t in turns:
        ways = []
        for state, (cost, audit) in inserted(best).items():
            ways.append((state, (cost + 3, audit + "D")))
            if t != "d":
                late, initial, to = int(t.isupper()), t.lower(), "a" if state == "U" else "u"
                if initial == "s" and state == "E":
                    ways.append(("S", (cost + late, audit + "K")))
                ways.append((to.upper(), (cost + late, audit + "K") if initial == to else (cost + late + 2, audit + "R")))
        best = {}
        for state, way in ways:
            best[state] = min(best.get(state, way), way)
    return min(way for state, way in inserted(best).items() if state in "EA")


def all_repairs(turns):
    """Every edit sequence with at most two insertions in each gap, for short conversations."""
    found = set()
    gaps = ["", "i", "ii"]
    for edits in itertools.product("DKRr", repeat=len(turns)):
        for inserts in itertools.product(gaps, repeat=len(turns) + 1):
            for kinds in itertools.product("ua", repeat=sum(map(len, inserts))):
                take, roles, audit, cost, good = iter(kinds), "", "", 0, True
                for i, gap in enumerate(inserts):
                    for _ in gap:
                        roles, audit, cost = roles + next(take), audit + "I", cost + 2
                    if i < len(turns):
                        t, e = turns[i], edits[i]
                        audit += e.upper()
                        if e == "D":
                            cost += 3
                            continue
                        good &= t != "d" and not (e == "K" and t.lower() not in "sua")
                        roles += t.lower() if e == "K" else "u" if e == "R" else "a"
                        cost += int(t.isupper()) + (0 if e == "K" else 2)
                if good and re.fullmatch("(s?(ua)+)?", roles):
                    found.add((cost, audit))
    return min(found)


def test_alignment():
    rng = random.Random(5)
    for turns in map("".join, itertools.chain(*(itertools.product("suaUdx", repeat=n) for n in range(3)))):
        assert align_turns(turns) == all_repairs(turns), turns
    for k in range(4000):
        n = rng.choice([15, 16, 17, 33, 50]) if k % 20 == 0 else rng.randrange(8)
        turns = "".join(rng.choice("suaxSUAXdd" if k % 2 else "uauaUAsd") for _ in range(n))
        assert align_turns(turns) == brute_repair(turns), turns
    long = "".join(rng.choice("ua"[i % 2] * 12 + "UAdsux") for i in range(3000))
    assert align_turns(long) == brute_repair(long)


def conversations(seed=6, n=60):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randrange(1, 12)):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.2 else ["user", "assistant"][t % 2] if t or rng.random() < 0.6 else "system"
            rows.append((c, t + rng.randrange(2), role, rng.choice(["Hello there.", "What?", " \t", "no end", "Again. ", "Größe!\n", f"turn {rng.randrange(5)}."])))
    rows += [(100, None, "user", "no number."), (100, None, None, "no role."), (100, 3, "tool", "x."), (101, 1, "user", None), (None, 1, "user", "null id."), (None, 2, "assistant", "b."), (102, 1, "ufo", "kept?"), (102, 2, "", "c.")]
    rows += [(103, t, ["user", "assistant"][t % 2], f"turn {t}." if t % 9 else "same") for t in range(700)] + [(104, 1, "user", "long " * 30_000 + "."), (104, 2, "assistant", "y" * 50_000)]
    return rows + rows[:3]


def brute_rows(rows):
    damaged = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        damaged[conv] += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    for conv, turns in damaged.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        seen, faults, codes = set(), collections.Counter(), []
        for _, role, text in turns:
            plain = text.strip(" \t\n\x0b\x0c\r")
            fault = "b" if not plain else "d" if (role, text) in seen else "t" if plain[-1] not in ".!?" else ""
            seen.add((role, text))
            faults[fault] += 1
            initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
            codes.append("d" if fault in ("b", "d") else initial.upper() if fault else initial)
        numbers = [t for t, _, _ in turns if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in itertools.pairwise(turns))
        cost, audit = brute_repair("".join(codes))
        lines, at = [], iter(turns)
        for edit in audit:
            last = lines[-1].split(":")[0][:1] if lines else ""
            role = "assistant" if last == "u" else "user"
            if edit == "I":
                lines.append(f"{role}:")
                continue
            _, own, text = next(at)
            if edit != "D":
                lines.append(f"{own if edit == 'K' else role}:{text}")
        out.append((conv, gaps, faults["b"], faults["d"], faults["t"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def test_conversations(spark):
    rows = conversations()
    df = spark.createDataFrame([(*r, "clash", 1, True) for r in rows], "conv_id long, turn long, role string, text string, audit string, conv int, is_turn boolean").repartition(3)
    damaged, dropped = damage(df)
    found = Conversations(damaged, dropped=dropped)
    audits = found.audits().cache()
    got = found.digests(audits)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute_rows(rows), key=repr)
    turns = collections.defaultdict(list)
    for r in found.repaired(audits).orderBy("place").collect():
        turns[r.conv_id].append(f"{r.role}:{r.text}")
    assert {r.conv_id: hashlib.sha256("\n".join(turns[r.conv_id]).encode()).hexdigest() for r in got.collect()} == {r.conv_id: r.repaired_sha256 for r in got.collect()}


def test_undamaged_conversations(spark):
    """Without damage, whatever already follows the grammar is kept as it is."""
    rows = [(1, 0, "system", "Be brief."), (1, 1, "user", "Hi!"), (1, 2, "assistant", "Hello."), (2, 0, "user", "Alone."), (3, 0, "assistant", "Only me.")]
    found = Conversations(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"))
    assert {r.conv_id: (r.cost, r.audit) for r in found.audits().collect()} == {1: (0, "KKK"), 2: (2, "KI"), 3: (2, "IK")}


def test_conversations_of_nothing(spark):
    damaged, dropped = damage(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    found = Conversations(damaged, dropped=dropped)
    assert found.digests(found.audits()).collect() == [] and found.repaired(found.audits()).collect() == []


def test_a_conversation_that_is_all_dropped(spark):
    gone = next(c for c in itertools.count() if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    damaged, dropped = damage(spark.createDataFrame([(gone, 0, "user", "x.")], "conv_id long, turn long, role string, text string"))
    found = Conversations(damaged, dropped=dropped)
    assert [tuple(r) for r in found.digests(found.audits()).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


@pytest.mark.parametrize("name", ["op11_source_divergence", "op12_hilbert_sharding", "op13_conversation_repair"])
def test_against_sql(spark, tmp_path, name):
    import duckdb

    from speechloom.llm import queries

    spark.createDataFrame(documents(), SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    distinct = [r for r in conversations() if r[0] not in (100, None)]
    distinct = list({(r[0], r[1]): r for r in distinct}.values())
    spark.createDataFrame(distinct, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = queries.QUERIES[name](spark, str(tmp_path))
    want = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)
