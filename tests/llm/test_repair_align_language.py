"""Conversation repair, tokenizer alignment and language ID against brute force and held-out rows."""

import hashlib
import os
import random
import re
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from surveyspark.llm import conversation_blocks, conversation_sql, lang_embed, token_alignment

TURNS = "conv_id long, turn long, role string, text string, symbols string, digest int"
DOCS = "doc_id long, text string, lang string, source string, cell int, pair int, place int"
BLANKS = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """Fault counts, cost, audit and repaired rows of `(turn, role, text)` in order, by all prefixes."""
    after = {"": "su", "s": "u", "u": "a", "a": "u"}

    def grown(best):
        todo = list(best)
        while todo:
            q = todo.pop()
            cost, audit, out = best[q]
            for name in ("user", "assistant"):
                z = name[0]
                if z in after[q] and (z not in best or (cost + 3, audit + "I") < best[z][:2]):
                    best[z] = (cost + 3, audit + "I", out + ((name, ""),))
                    todo.append(z)
        return best

    seen, faults = set(), Counter()
    best = grown({"": (0, "", ())})
    for _, role, text in rows:
        bare = text.strip(BLANKS)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated"
        seen.add((role, text))
        faults[fault] += 1
        new = {}
        for q, (cost, audit, out) in best.items():
            found = [(q, cost + 4, audit + "D", out)]
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                if role[:1] and role[0] in after[q]:
                    found.append((role[0], cost + more, audit + "K", out + ((role, text),)))
                found += [
                    (name[0], cost + 3 + more, audit + "R", out + ((name, text),))
                    for name in ("user", "assistant")
                    if name[0] in after[q]
                ]
            for z, *rest in found:
                if z not in new or tuple(rest[:2]) < new[z][:2]:
                    new[z] = tuple(rest)
        best = grown(new)
    cost, audit, out = min((best[q] for q in ("", "a") if q in best), key=lambda v: v[:2])
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(p[1][:1] + n[1][:1] not in ("su", "ua", "au") for p, n in zip(rows, rows[1:]))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, digest), out


def in_order(rows):
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    return sorted(rows, key=lambda v: (v[0] is not None, v[0] or 0, v[1], hashlib.md5(v[2].encode()).digest()))


def made_conversations():
    pick = random.Random(11)
    roles = ["user", "assistant", "system", None, "", "tool", "user", "assistant"]
    texts = ["Yes.", "No", "  ", "", None, "Why?\n", "Well, then", "ok!" + " " * 30, "ä😀.", "x" * 20_000]
    made = []
    for conv in range(40):
        for turn in range(pick.choice([1, 2, 5, 9, 14])):
            made.append((conv or None, None if pick.random() < 0.1 else turn - pick.randrange(2), pick.choice(roles), pick.choice(texts)))
    return [(*row, "s", 1) for row in made]


@pytest.fixture(scope="module")
def turns(spark):
    return spark.createDataFrame(made_conversations(), TURNS).repartition(3)


def by_conversation(rows):
    out = {}
    for conv, *row in rows:
        out.setdefault(conv, []).append(tuple(row))
    return out


def test_audit_is_the_cheapest_repair(turns):
    got = {r.conv_id: tuple(r)[1:] for r in conversation_blocks.audit(turns, turns).collect()}
    given = by_conversation([row[:4] for row in made_conversations()])
    assert got == {conv: cheapest(in_order(rows))[0] for conv, rows in given.items()}


def test_long_conversations_are_chunked(spark, monkeypatch):
    monkeypatch.setattr(conversation_blocks, "CHUNK", 5)
    pick = random.Random(3)
    rows = [(7, k // 3, pick.choice(["user", "assistant", "tool"]), pick.choice(["a.", "b", "c!", ""]) + str(k % 50) + ".") for k in range(400)]
    rows += [(7, 200, "user", "again.")] * 23
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    want, out = cheapest(in_order([r[1:] for r in rows]))
    assert tuple(conversation_blocks.audit(df, df).first())[1:] == want
    # repair gives the same edits row by row
    edits = conversation_blocks.repair(df).orderBy("place").collect()
    assert "".join(e.edit for e in edits) == want[6]
    assert [(e.role, e.text) for e in edits if e.edit != "D"] == list(out)


def test_conversation_blocks_expand_like_single_steps():
    of = conversation_blocks.Tables()
    pick = random.Random(5)
    for n in (0, 1, 3, 4, 5, 8, 41):
        symbols = bytes(pick.randrange(9) for _ in range(n))
        costs = list(conversation_blocks.END)
        for s in reversed(symbols):
            costs = conversation_blocks.before(s, tuple(costs))
        cost, pieces = of.edits(symbols)
        assert cost == costs[0]
        assert sum(len(p) - p.count("I") for p in pieces) == n


def test_damage_and_sql(spark, turns):
    rows = [row[:4] for row in made_conversations()]
    kept = duckdb.connect()
    kept.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    kept.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    want = sorted(kept.sql(conversation_sql.AUDIT).fetchall(), key=str)
    got = conversation_blocks.audit(conversation_blocks.damaged(turns), turns).collect()
    assert sorted(map(tuple, got), key=str) == want


def test_empty_and_fully_dropped_conversations(spark, turns):
    none = turns.limit(0)
    assert conversation_blocks.audit(none, none).count() == 0
    assert conversation_blocks.repair(none).count() == 0
    got = {tuple(r)[1:] for r in conversation_blocks.audit(none, turns).collect()}
    assert got == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


LATIN = "the cat sat on the mat and then it ran away from internationalisation"
TEXTS = [
    None,
    "",
    " ",
    "a",
    LATIN,
    LATIN,
    "two  blanks\tand\n\nlines <s> </s> <|endoftext|> <0x41>",
    "naïve façade — 東京タワー 😀😀 Привет",
    "a ▁ b",
    "x" * 3000,
    "\u0000 nul",
    " leading and trailing ",
    " ".join(f"w{k}x{k * k}" for k in range(3000)),
]


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(k, t, "en", "s", 1, 2, 3) for k, t in enumerate(TEXTS)] + [(None, LATIN, None, "s", 1, 2, 3)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def plain_alignment(rows):
    of = token_alignment.Pair(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own.encode_special_tokens = True
    counts, kept = Counter(), []
    for doc, text in rows:
        a = own.encode(" " + text, add_special_tokens=False).ids if text else []
        b = of.b.encode(text) if text else []
        raw = (" " + text).encode() if text else b""
        if not text or any(b"".join(side[k] for k in ids) != raw for side, ids in ((of.bytes_a, a), (of.bytes_b, b))):
            kept.append((doc, 0, 0, [], ""))
            continue
        ends_a = np.cumsum([len(of.bytes_a[k]) for k in a]).tolist()
        ends_b = np.cumsum([len(of.bytes_b[k]) for k in b]).tolist()
        links, groups, i, j = [], [], 0, 0
        for cut in sorted(set(ends_a) & set(ends_b)):
            p, q = ends_a.index(cut) + 1, ends_b.index(cut) + 1
            links.append((a[p - 1], b[q - 1]))
            groups.append(",".join(map(str, a[i:p])) + "|" + ",".join(map(str, b[j:q])))
            i, j = p, q
        counts.update(links)
        kept.append((doc, len(a), len(b), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    return sorted(
        (
            (doc, na, nb, len(links), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), digest)
            for doc, na, nb, links, digest in kept
        ),
        key=str,
    )


def test_alignment_is_that_of_all_ends(texts):
    want = plain_alignment([(r.doc_id, r.text) for r in texts.collect()])
    assert sorted(map(tuple, token_alignment.alignment(texts).collect()), key=str) == want
    assert sum(w[1] == 0 for w in want) >= 3  # null, empty, and a mark that is not given back


def test_alignment_of_parts_and_small_cells(texts, monkeypatch):
    want = plain_alignment([(r.doc_id, r.text) for r in texts.collect()])
    monkeypatch.setattr(token_alignment, "SLICE", 40)
    monkeypatch.setattr(token_alignment, "CELL_LINKS", 9)
    assert sorted(map(tuple, token_alignment.alignment(texts).collect()), key=str) == want


def test_common_ends_on_random_cuts():
    pick = np.random.default_rng(4)
    for share in (0.02, 0.3, 0.9):
        ends_a, ends_b, last_a, last_b, base = [], [], [], [], 0
        for size in (1, 2, 700, 3000):
            for ends, last in ((ends_a, last_a), (ends_b, last_b)):
                inner = np.flatnonzero(pick.random(size - 1) < share) + 1 if size > 1 else []
                ends += [base + int(k) for k in inner] + [base + size]
                last.append(len(ends) - 1)
            base += size
        a, b = np.array(ends_a), np.array(ends_b)
        found_a, found_b = token_alignment.common_ends(a, b, np.array(last_a), np.array(last_b))
        assert a[found_a].tolist() == b[found_b].tolist() == sorted(set(ends_a) & set(ends_b))


def test_ranks_say_the_same_as_merges():
    path = public_tokenizers.path("byte_bpe_50k.json")
    of = token_alignment.Pair(path, public_tokenizers.path("piece_bpe_32k.model"))
    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    assert "ranked" in of.encode_a.__code__.co_freevars
    pick = random.Random(2)
    kinds = ["aab ", "abcdefghijklmnopqrstuvwxyz ", "éàüß ñ", "01 23.,;'s", "日本語кирил 😀", "\t\n  x", "AaBb<|>endoftext"]
    for _ in range(3000):
        text = "".join(pick.choice(pick.choice(kinds)) for _ in range(pick.randrange(60)))
        assert of.encode_a(text).tolist() == own.encode(text, add_special_tokens=False).ids, text
    assert of.encode_a("<|endoftext|>").tolist() == own.encode("<|endoftext|>", add_special_tokens=False).ids


def test_alignment_of_nothing(texts):
    assert token_alignment.alignment(texts.limit(0)).count() == 0
    assert token_alignment.alignment(texts.where("text is null")).first().groups_sha256 == ""


SPOKEN = {
    "en": "the of and to in is that it was for on are with they this have from one had word but what some we can out other were all there when",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec ils mais comme ou si leur y",
}


@pytest.fixture(scope="module")
def spoken(spark):
    pick = random.Random(8)
    rows = []
    for k in range(600):
        lang = pick.choice(list(SPOKEN))
        rows.append((k, " ".join(pick.choices(SPOKEN[lang].split(), k=pick.randrange(5, 60))), lang if k % 7 else None, lang, 1, 2, 3))
    rows += [(None, None, "en", "s", 1, 2, 3), (1001, "", "en", "s", 1, 2, 3), (1002, "12 !? 34", "de", "s", 1, 2, 3)]
    rows += [(1003, "und " * 700_000, "de", "de", 1, 2, 3), rows[5], rows[5]]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def test_languages_of_held_out_rows(spoken):
    got = lang_embed.languages(spoken).join(spoken.select("doc_id", "source").distinct(), "doc_id").collect()
    held = [r for r in got if r.held_out and r.doc_id < 1000]
    assert len(held) > 100
    assert np.mean([r.lang_pred == r.source for r in held]) > 0.97
    accepted = [r for r in held if r.accepted]
    assert len(accepted) > 0.8 * len(held) and np.mean([r.lang_pred == r.source for r in accepted]) > 0.98
    assert {r.lang_pred for r in got if r.doc_id in (1001, 1002)} == {"und"}
    assert all(0 <= r.score <= 1 for r in got)
    assert next(r for r in got if r.doc_id == 1003).lang_pred == "de"


def test_held_out_languages_teach_nothing(spark, spoken):
    from pyspark.sql import functions as F

    wrong = spoken.withColumn("lang", F.when(lang_embed.held_out("doc_id"), "zz").otherwise(F.col("lang")))
    one, two = (sorted(map(tuple, lang_embed.languages(d).collect()), key=str) for d in (spoken, wrong))
    assert one == two


def test_languages_without_rows_to_learn_from(spark, spoken):
    assert lang_embed.languages(spoken.limit(0)).count() == 0
    nothing = spark.createDataFrame([(k, "some words", None, "s", 1, 2, 3) for k in range(3)], DOCS)
    assert {tuple(r)[2:] for r in lang_embed.languages(nothing).collect()} == {("und", 0.0, False)}
    one = spark.createDataFrame([(k, "some words", "en", "s", 1, 2, 3) for k in range(30)], DOCS)
    assert {(r.lang_pred, r.score) for r in lang_embed.languages(one).collect()} == {("en", 1.0)}


def test_buckets_do_not_depend_on_slices(monkeypatch):
    text = "Größe and ÉTÉ, l'été 12 naïve " * 40
    whole = np.sort(np.concatenate(list(lang_embed.buckets(text))))
    monkeypatch.setattr(lang_embed, "SLICE", 37)
    assert np.sort(np.concatenate(list(lang_embed.buckets(text)))).tolist() == whole.tolist()
    plain = []
    for word in re.findall(r"[^\W\d_]+", text.lower()):
        marked = f"\0{word}\0"
        plain += [marked[k : k + n] for n in lang_embed.GRAMS for k in range(len(marked) - n + 1)]
    assert len(plain) == len(whole)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the given tables")
def test_languages_of_the_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = lang_embed.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.99
