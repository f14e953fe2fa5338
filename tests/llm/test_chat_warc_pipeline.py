"""Chat formatting, WARC archives, the pipeline."""

import gzip
import io
import json
import random
import re
import zlib

import pytest

import corpus_pipeline
from chorale.llm import bpe, chat, common, decontamination, exact_dedup, near_dedup, quality, warc
from tests.llm.helpers import LONG, TRICKY, docs, near_components, oracle, same_rows

TURN = "conv_id long, turn long, role string, text string"
TALK = [
    (1, 0, "system", "be \\ nice <<SYS>> x <</SYS>>"), (1, 2, "assistant", " </s> "), (1, 1, "user", "[INST] \\[INST] <s>"), (2, None, None, None), (2, 0, "assistant", None),
    (2, 0, "assistant", None), (3, 5, "tool", "[ROLE]t[/ROLE]"), (3, 6, "assis\ntant<s>", "x"), (3, 7, "assistant", "é\U0001f389\n"), (4, 0, "user", LONG), (None, 0, "assistant", "orphan"),
]
TALK += [(5, i, "user" if i % 2 == 0 else "assistant", f"turn {i} \\") for i in range(700)]


def turns(spark, rows):
    return spark.createDataFrame(rows, TURN).selectExpr("*", "'x' AS segment", "'y' AS loss", "1 AS n_turns")


def test_chat_against_sql(spark):
    table = turns(spark, TALK)
    got = chat.read_back(chat.format_conversations(table)).toArrow()
    # nulls first, as the operator orders turns
    sql = chat.ORACLE_SQL.replace("ORDER BY turn, role, text", "ORDER BY turn NULLS FIRST, role, text")
    want = oracle("SELECT * FROM (" + sql + ") WHERE conv_id IS DISTINCT FROM -7", conversations=table)
    assert same_rows(got, want)
    assert chat.read_back(chat.format_conversations(turns(spark, []))).count() == 0


def test_chat_query(spark, data):
    got = chat.op3(spark, data)
    assert same_rows(got.toArrow(), oracle(chat.ORACLE_SQL, conversations=spark.read.parquet(f"{data}/conversations.parquet")))
    assert got.filter("conv_id = -7").first().loss_chars == len(chat.PROBE)


@pytest.mark.parametrize("text", ["", "\\", "</s>", "<\\/s>", "[INST][/INST]", "<<<SYS>>>", "\\\\<s>\\"])
def test_escapes_are_undone(text):
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text and not any(c in escaped for c in chat.CONTROLS)
    assert chat.parse(chat.TEMPLATE([("user", text), ("assistant", text), ("x", text)])) == [("user", text), ("assistant", text), ("x", text)]


def _spans(template, talk, **options):
    f = chat.Formatter(template, **options)
    return [f.add(*t) for t in talk]


def test_long_conversations_need_no_whole_prefixes():
    talk = [("user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(300)]
    longest = []

    def watched(turns):
        longest.append(len(turns))
        return chat.TEMPLATE(turns)

    parts = _spans(watched, talk)
    assert "".join(p[0] for p in parts) == chat.TEMPLATE(talk)
    assert all(p[0][p[1] : p[2]] == t[1] and not p[3] for p, t in zip(parts, talk))
    assert max(longest[-300:]) <= chat.LOOKBACK + 1


def test_template_that_numbers_turns_is_not_local():
    talk = [("user", f"t{i}") for i in range(120)]
    numbered = lambda turns: "".join(f"{i}:{t};" for i, (_, t) in enumerate(turns))
    parts = _spans(numbered, talk)
    assert "".join(p[0] for p in parts) == numbered(talk) and not any(p[3] for p in parts)


def test_template_that_rewrites_history_is_detected(spark):
    # only the last assistant turn keeps its text
    last_only = lambda turns: "".join(f"<{r}>{t if r == 'user' or i == len(turns) - 1 else '-'}</>" for i, (r, t) in enumerate(turns))
    parts = _spans(last_only, [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d")])
    assert [p[3] for p in parts] == [False, False, True, False]
    rows = chat.format_conversations(turns(spark, [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c")]), last_only).collect()
    assert rows[0].rewrites == 1 and rows[0].text == "<user>a</><assistant>-</><user>c</>"


@pytest.mark.parametrize("at", [60, 300])
def test_templates_that_act_late_are_rendered_whole(spark, at):
    # a system turn is moved to the front; only the last 60 turns are kept
    hoisted = lambda turns: "".join(f"<{r}>{t}</>" for r, t in sorted(turns, key=lambda x: x[0] != "system"))
    window = lambda turns: "".join(f"<{r}>{t}</>" for r, t in turns[-60:])
    talk = [("system" if i == at else "user", f"t{i}") for i in range(at + 20)]
    for template in (hoisted, window):
        rows = chat.format_conversations(turns(spark, [(1, i, r, t) for i, (r, t) in enumerate(talk)]), template).collect()
        assert [r.text for r in rows] == [template(talk)] and rows[0].n_turns == len(talk) and rows[0].rewrites > 0


# --- WARC ------------------------------------------------------------------------------------------------------------------

PAGE = "page_id long, url string, html string"
BODY = "é<p>" + "x" * 1200
PAGES = [(1, "http://a/b c\r\nX: y", BODY), (2, None, BODY), (7, "u", BODY), (7, "u", BODY), (3, "u", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (8, "u", "a\r\n\r\nWARC/1.1\r\n\r\nb" + LONG), (None, "u", BODY), (9, "u", BODY + "!")]


def pages(spark, rows):
    return spark.createDataFrame(rows, PAGE).selectExpr("*", "'x' AS digest", "'y' AS refers_to", "1 AS n")


def _round_trip(spark, table, per_file=3):
    raw, folder = common.fresh_path(spark, "test-raw"), common.fresh_path(spark, "test-warc")
    warc.write_monolithic(table, raw, per_file)
    manifest = warc.normalised_archives(spark, raw, folder)
    return manifest, folder, warc.read_archives(manifest, folder)


def test_warc_against_sql(spark):
    table = pages(spark, PAGES)
    manifest, _, got = _round_trip(spark, table)
    want = oracle(warc.ORACLE_SQL, pages=table)
    assert same_rows(got.toArrow(), want)
    assert manifest.count() >= 4
    assert _round_trip(spark, pages(spark, []))[2].count() == 0


def test_warc_on_the_table(spark, data):
    assert same_rows(warc.op8(spark, data).toArrow(), oracle(warc.ORACLE_SQL, pages=spark.read.parquet(f"{data}/pages.parquet")))


def test_every_record_is_a_member_and_the_index_finds_it(spark):
    manifest, _, _ = _round_trip(spark, pages(spark, PAGES), 100)
    n = 0
    for row in manifest.collect():
        data = open(row.archive, "rb").read()
        for line in open(f"{row.archive}.idx"):
            offset, length, kind, name = json.loads(line)
            record = zlib.decompress(data[offset : offset + length], 31)
            assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n") and f"WARC-Type: {kind}".encode() in record and name.encode() in record
            n += 1
        assert gzip.decompress(data)
    assert n == len(PAGES)


def test_normaliser_takes_several_members_and_refuses_a_cut_stream():
    record = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    out, index = io.BytesIO(), io.BytesIO()
    assert warc.normalise(io.BytesIO(gzip.compress(record * 2) + gzip.compress(record)), out, index) == 3
    with pytest.raises(ValueError):
        warc.normalise(io.BytesIO(gzip.compress(record[:-9])), io.BytesIO(), io.BytesIO())


def test_wrong_digest_is_refused():
    record = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nWARC-Payload-Digest: sha1:00\r\nContent-Length: 22\r\n\r\nHTTP/1.1 200 OK\r\n\r\nabc\r\n\r\n"
    with pytest.raises(ValueError):
        warc.read_record(record)


# --- the pipeline ----------------------------------------------------------------------------------------------------------


def test_pipeline_against_a_brute_force_version(spark):
    from tokenizers import Tokenizer

    data = "/root/testdata/sf0.01"

    documents, labels, benchmark = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    texts = {r.doc_id: r.text for r in documents.collect()}
    good = {r.doc_id for r in quality.score_documents(documents, labels).collect() if r.predicted}
    seen, kept = set(), []
    left = [len(texts), len(good)]
    for i in sorted(good):
        key = re.sub(exact_dedup.SPACES, " ", texts[i])
        if key not in seen:
            seen.add(key)
            kept.append(i)
    left.append(len(kept))
    kept = [i for i, (_, c) in near_components([(i, texts[i]) for i in kept]).items() if i == c]
    bad = oracle(f"SELECT doc_id FROM ({decontamination.ORACLE_SQL}) WHERE n_items >= 1 AND n_hit >= 8", documents=documents, benchmark=benchmark).to_pydict()["doc_id"]
    library = Tokenizer.from_file(bpe.vocabulary_path())
    want = {i: len(library.encode(texts[i], add_special_tokens=False).ids) for i in kept if i not in set(bad)}
    assert {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, data).collect()} == want
    left += [len(kept), len(want)]
    assert all(a > b for a, b in zip(left, left[1:])), "every stage removes something"


def test_stages_return_the_columns_they_got(spark, data):
    table = docs(spark, TRICKY)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, data)
        assert out.columns == table.columns, name
        assert out.filter("doc_id is null").count() == 1
    assert [n for n, _ in corpus_pipeline.STAGES][2] == "MinHash near-dedup" and near_dedup.WORDS == 5


def test_random_templates_round_trip():
    rng = random.Random(0)
    for _ in range(200):
        talk = [(rng.choice(["user", "assistant", "system", "tool", ""]), "".join(rng.choice(["<s>", "</s>", "\\", " ", "[INST]", "[/ROLE]", "a", "\n", "<<SYS>>"]) for _ in range(rng.randint(0, 8)))) for _ in range(rng.randint(1, 6))]
        assert chat.parse(chat.TEMPLATE(talk)) == talk
