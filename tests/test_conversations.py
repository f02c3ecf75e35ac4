import json
from datetime import datetime

import pytest
from plan_texts import plan
from pyspark.sql import functions as F

from tabulon.operators import conversations as C
from tabulon.sources import chat_store
from tabulon.streaming import autosave

NOW, THEN = datetime(2024, 5, 1), datetime(2024, 1, 1)
SCHEMA = "chat_id bigint, turn bigint, role string, content string, figure_b64 string"


@pytest.fixture(scope="module")
def messages(spark):
    rows = [
        (1, 0, " user ", " Hallo " + "x" * 100, None),
        (1, 1, "assistant", "   ", None),
        (1, 2, "assistant", "Antwort", "YWJj"),
        (1, 3, "system", "intern", None),
        (1, 4, "user", "", None),
        (2, 0, "user", " \n ", None),
        *[(3, t, "user" if t % 2 == 0 else "assistant", f"m{t} " + "y" * 400, None) for t in range(10)],
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_clean(messages):
    stored = C.clean_for_storage(messages).where("chat_id < 3").orderBy("turn").collect()
    assert [(r["turn"], r["role"]) for r in stored] == [(0, "user"), (2, "assistant"), (3, "system")]
    loaded = C.clean_loaded(messages).where("chat_id = 1").orderBy("turn").collect()
    assert [r["turn"] for r in loaded] == [0, 2] and bytes(loaded[1]["figure"]) == b"abc"


def test_records(messages):
    rows = {r["chat_id"]: r for r in C.chat_records(C.clean_for_storage(messages), F.lit("s.csv"), F.lit(NOW)).collect()}
    assert set(rows) == {1, 3} and rows[1]["title"] == "Hallo " + "x" * 64 and rows[1]["messages"] == 3


def line(role, content, figure=None):
    return f"{role}: {content}{' [Diagramm]' if figure else ''}".strip()


def expected_preview(rows, limit):
    text = "\n".join(line(r["role"], r["content"], r["figure_b64"]) for r in rows if r["content"])
    return text if len(text) <= limit else text[:limit].rstrip() + "\n...[gekuerzt]"


def expected_context(rows, last, limit):
    kept = [(r["role"].strip(), r["content"].strip()) for r in rows[-last:]]
    text = "\n".join(f"{a}: {b}" for a, b in kept if a and b)
    return text[-limit:]


@pytest.mark.parametrize("limit", [3, 20, 60, 900])
def test_preview(messages, limit):
    rows = messages.orderBy("turn").collect()
    found = {r["chat_id"]: r["preview"] for r in C.conversation_preview(messages, limit).collect()}
    for chat in (1, 2, 3):
        assert found[chat] == expected_preview([r for r in rows if r["chat_id"] == chat], limit)


@pytest.mark.parametrize("last,limit", [(8, 3000), (3, 3000), (2, 10), (8, 500)])
def test_context(messages, last, limit):
    rows = messages.orderBy("turn").collect()
    found = {r["chat_id"]: r["context"] for r in C.recent_context(messages, last, limit).collect()}
    for chat in (1, 2, 3):
        assert found[chat] == expected_context([r for r in rows if r["chat_id"] == chat], last, limit)


def test_context_limits_before_the_shuffle(messages):
    text = plan(C.recent_context(messages))
    assert text.count("WindowGroupLimit") >= 2


def test_upsert(spark, messages):
    chats = spark.createDataFrame(
        [(1, "Alt", "a.csv", THEN, THEN, True), (3, "Drei", "a.csv", THEN, THEN, False), (7, "Bleibt", "a.csv", THEN, THEN, False)], chat_store.CHATS
    )
    incoming = spark.createDataFrame(
        [(1, None, "b.csv", False), (3, " Neu ", "b.csv", True), (2, "leer", "b.csv", True)],
        "chat_id bigint, title string, source_name string, autosaved boolean",
    )
    rows = {r["chat_id"]: tuple(r)[1:] for r in C.upsert_chats(chats, incoming, messages, F.lit(NOW)).collect()}
    assert rows == {
        1: ("Alt", "b.csv", THEN, NOW, True),
        3: ("Neu", "b.csv", THEN, NOW, True),
        7: ("Bleibt", "a.csv", THEN, THEN, False),
    }
    fresh = C.upsert_chats(chats.where("false"), incoming, messages, F.lit(NOW))
    assert [r["chat_id"] for r in C.list_chats(fresh).collect()] == [1, 3]
    kept = C.upsert_messages(messages, messages.where("chat_id = 3 AND turn = 9"))
    assert kept.where("chat_id = 3").count() == 1 and kept.where("chat_id = 1").count() == 5


def test_load_and_delete(spark, messages):
    assert [r["turn"] for r in C.load_chat(messages, 1).collect()] == [0, 2]
    for missing in (2, 99):
        with pytest.raises(ValueError):
            C.load_chat(messages, missing)
    ids = spark.createDataFrame([(1,), (1,)], "chat_id bigint")
    assert {r["chat_id"] for r in C.delete_chats(messages, ids).collect()} == {2, 3}
    assert C.load_chats(messages, ids).count() == 2


def test_source_mismatch(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("", "b"), (None, "b"), ("a", None)], "s string, t string")
    found = df.select(C.source_mismatch(F.col("s"), F.col("t")), C.source_changed(F.col("s"), F.col("t"))).collect()
    assert [tuple(r) for r in found] == [(False, False), (True, True), (False, True), (False, True), (True, True)]


def test_missing_store_is_empty(spark, tmp_path):
    assert chat_store.read_or_empty(spark, str(tmp_path / "none"), chat_store.MESSAGES).count() == 0


def test_autosave_is_idempotent_and_independent_of_batches(spark, tmp_path):
    source, store = tmp_path / "in", str(tmp_path / "store")
    source.mkdir()

    def drop(name, rows):
        with open(source / f".{name}", "w") as file:
            file.writelines(json.dumps(dict(zip(("chat_id", "turn", "role", "content"), r))) + "\n" for r in rows)
        (source / f".{name}").rename(source / f"{name}.json")

    def run(checkpoint, now):
        stream = spark.readStream.schema(SCHEMA).json(str(source))
        autosave.autosave(stream, store, str(tmp_path / checkpoint), "s.csv", lambda: now).awaitTermination()

    drop("a", [(1, 0, "user", " Frage "), (1, 1, "assistant", "Antwort"), (2, 0, "user", "Zwei"), (2, 1, "user", " ")])
    run("c1", THEN)
    drop("b", [(1, 1, "assistant", "Antwort neu"), (1, 2, "user", "Danke")])
    run("c1", NOW)
    run("c1", NOW)
    found = [tuple(r) for r in autosave.stored_messages(spark, store).orderBy("chat_id", "turn").select("chat_id", "turn", "content").collect()]
    assert found == [(1, 0, "Frage"), (1, 1, "Antwort neu"), (1, 2, "Danke"), (2, 0, "Zwei")]
    chats = {r["chat_id"]: r for r in autosave.stored_chats(spark, store).collect()}
    assert (chats[1]["title"], chats[1]["created_at"], chats[1]["updated_at"]) == ("Frage", THEN, NOW)
    assert (chats[2]["title"], chats[2]["updated_at"], chats[2]["autosaved"]) == ("Zwei", THEN, True)
    run("c2", NOW)  # a lost checkpoint replays everything into the same folders
    again = autosave.stored_messages(spark, store).count()
    assert again == 4


def test_store_of_saves(spark, messages, tmp_path):
    path = str(tmp_path / "store")
    rows = messages.select("chat_id", "turn", "role", "content", "figure_b64")
    chat_store.append_save(rows, path, 0)
    newer = rows.where("chat_id = 1").limit(2)
    chat_store.append_save(newer, path, 1, removed=rows.where("chat_id = 2"))
    chat_store.append_save(newer, path, 1, removed=rows.where("chat_id = 2"))  # a repeat
    got = chat_store.current(spark, path, chat_store.MESSAGES)
    wanted = {1: 2, 3: rows.where("chat_id = 3").count()}
    assert {r["chat_id"]: r["n"] for r in got.groupBy("chat_id").agg(F.count("*").alias("n")).collect()} == wanted
    chat_store.compact(spark, path, path + "-2", chat_store.MESSAGES)
    assert sorted(map(str, chat_store.current(spark, path + "-2", chat_store.MESSAGES).collect())) == sorted(map(str, got.collect()))
    assert chat_store.current(spark, path + "-none", chat_store.MESSAGES).count() == 0


def seen(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_reads_touch_the_buckets_of_their_chats(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.range(600).selectExpr("id % 300 AS chat_id", "id AS turn", "'user' AS role", "'text ' || id AS content", "CAST(NULL AS STRING) AS figure_b64")
    chat_store.append_save(rows, path, 0)
    chat_store.append_save(rows.where("chat_id < 3"), path, 1, removed=rows.where("chat_id = 7"))
    whole = chat_store.current(spark, path, chat_store.MESSAGES)
    one = chat_store.current_chat(spark, path, chat_store.MESSAGES, 2)
    assert seen(one) == seen(whole.where("chat_id = 2")) and one.count() == 2
    assert chat_store.current_chat(spark, path, chat_store.MESSAGES, 7).count() == 0 == chat_store.current_chat(spark, path, chat_store.MESSAGES, 9999).count()
    read = lambda df: {f.split("/data/")[1].rsplit("/", 1)[0] for f in df.inputFiles() if "/data/" in f}
    assert len(read(one)) == 2 < len(read(whole)) / 10  # one bucket of either save
    incoming = spark.createDataFrame([(2, "t", "s", False)], "chat_id bigint, title string, source_name string, autosaved boolean")
    chat_store.save_chats(spark, path + "-chats", 0, incoming, rows, F.lit(NOW))
    chat_store.save_chats(spark, path + "-chats", 1, incoming.withColumn("title", F.lit(None).cast("string")), rows, F.lit(THEN))
    assert [(r["title"], r["created_at"], r["updated_at"]) for r in chat_store.current(spark, path + "-chats", chat_store.CHATS).collect()] == [("t", NOW, THEN)]


def test_a_save_shows_when_it_is_complete(spark, messages, tmp_path, monkeypatch):
    from tabulon.sources import manifest

    path = str(tmp_path / "store")
    rows = messages.select("chat_id", "turn", "role", "content", "figure_b64")
    chat_store.append_save(rows, path, 0)
    before = seen(chat_store.current(spark, path, chat_store.MESSAGES))

    def lost(df):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(manifest, "_ddl", lost)  # the data is written, its entries are not
        with pytest.raises(RuntimeError):
            chat_store.append_save(rows.withColumn("content", F.lit("new")), path, 1)
        assert seen(chat_store.current(spark, path, chat_store.MESSAGES)) == before
        with pytest.raises(RuntimeError):
            chat_store.compact_store(spark, path, chat_store.MESSAGES, 1)
    assert seen(chat_store.current(spark, path, chat_store.MESSAGES)) == before
    chat_store.append_save(rows.limit(0), path, 0)  # a repeat without rows takes the place of what it repeats
    assert chat_store.current(spark, path, chat_store.MESSAGES).count() == 0


def test_compacted_stores_read_the_same(spark, messages, tmp_path):
    from tabulon.sources import manifest

    path, base = str(tmp_path / "saves"), messages.select("chat_id", "turn", "role", "content", "figure_b64")
    for save in range(6):
        chat_store.append_save(base.where(f"chat_id % 3 <> {save % 3}").withColumn("content", F.concat("content", F.lit(f" {save}"))), path, save, removed=base.where("chat_id = 2") if save == 4 else None)
    before = chat_store.current(spark, path, chat_store.MESSAGES)
    want, folders = seen(before), manifest.entries(spark, path).count()
    assert chat_store.compact_store(spark, path, chat_store.MESSAGES, 3) > 0
    assert seen(before) == want == seen(chat_store.current(spark, path, chat_store.MESSAGES))  # a reader from before, and one from after
    assert manifest.entries(spark, path).count() < folders
    assert chat_store.compact_store(spark, path, chat_store.MESSAGES, 3) == 0
    chat_store.append_save(base.where("chat_id = 1").limit(1), path, 6)
    assert chat_store.current_chat(spark, path, chat_store.MESSAGES, 1).count() == 1

    store = str(tmp_path / "stream")
    for batch in range(5):
        stamp = F.lit(NOW).cast("timestamp") if batch % 2 else F.lit(THEN).cast("timestamp")
        rows = C.clean_for_storage(base).where(f"turn % 5 >= {batch}").withColumns({"content": F.concat("content", F.lit(f"/{batch}")), "source_name": F.lit(f"s{batch}"), "saved_at": stamp, "first_saved": stamp})
        manifest.append(rows, store, batch)
    views = lambda: (seen(autosave.stored_messages(spark, store)), seen(autosave.stored_chats(spark, store)))
    want, one = views(), base.where("chat_id = 1").select("chat_id")
    assert autosave.compact(spark, store, 2) > 0 and views() == want
    assert seen(autosave.stored_messages(spark, store, one)) == seen(autosave.stored_messages(spark, store).where("chat_id = 1"))
    manifest.append(rows, store, 4)  # the last batch again
    assert views() == want and autosave.compact(spark, store, 2) >= 0 and views() == want
