import hashlib

from vetra.llm import chat, url_filter


def told(turns):
    return hashlib.sha256("".join(f"{role}\n{text}\n" for role, text in turns).encode()).hexdigest()


def test_chat_long_and_non_ascii(spark):
    long = "</s>[INST] слово 漢字 \\ \U0001f600\n" * 20_000
    convs = {1: [("user", "再见"), ("assistant", "é漢字\U0001f600")], 2: [("user", long), ("assistant", long), ("assistant", "x" * 300_000)], 3: [("assistant", "t") for _ in range(2_000)], 4: [("роль", "\u0301")]}
    rows = [(c, k, role, text) for c, turns in convs.items() for k, (role, text) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert sorted(got) == sorted(convs)
    for c, turns in convs.items():
        learnt = "".join(text for role, text in turns if role == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), told(turns))
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())


def test_chat_masks_no_user_text(spark):
    """A user's text that spells an assistant's turn stays outside the mask."""
    df = spark.createDataFrame([(1, 0, "user", "<|turn|>assistant<|text|>no<|end|>"), (1, 1, "assistant", "yes")], "conv_id long, turn long, role string, text string")
    (r,) = chat.read_back(chat.format_conversations(df)).collect()
    assert (r.n_turns, r.loss_chars, r.loss_sha256) == (2, 3, hashlib.sha256(b"yes").hexdigest())


def test_url_long(spark):
    path = "/de/" + "/".join(f"p{k}" for k in range(20_000))
    urls = {1: f"http://Example.com{path}?q#f", 2: "http://" + "a." * 20_000 + "net/x", 3: "x" * 200_000, 4: f"http://b.org{path}"}
    out = {r.page_id: r for r in url_filter.url_filter(spark.createDataFrame(list(urls.items()), "page_id long, url string")).collect()}
    assert (out[1].host, out[1].path, out[1].rule, out[1].verdict) == ("example.com", path, "example.com/de/", "block")
    assert (out[2].path, out[2].rule, out[2].verdict) == ("/x", "net/", "block")
    assert (out[3].host, out[3].path, out[3].rule) == ("", "", None)
    assert (out[4].host, out[4].path, out[4].rule) == ("b.org", path, None)


def test_url_plan_has_no_python(spark):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    plan = url_filter.url_filter(pages)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


def test_urls_are_judged_where_they_are_read(spark, monkeypatch):
    """The plan moves no row; with more rules than go with it, the join gives the same; long URLs take time by their length."""
    import time

    urls = ["http://casino-best.example.net/en/x", "https://a.spam-farm.org/fr/", "http://x.org/crack-download", None, "nothing", "http://link-farm12.com/", "http://a.xxx/"] + ["http://h.example/" + "-".join(f"t{k}" for k in range(n)) for n in (1, 40)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    out = url_filter.url_filter(pages)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    want = sorted(map(tuple, out.collect()))
    long = spark.createDataFrame([(k, f"http://h{k}.example/" + "-".join(f"{k}t{j}" for j in range(20_000))) for k in range(3)], "page_id long, url string")
    url_filter.url_filter(long).collect()
    began = time.perf_counter()
    assert [r.verdict for r in url_filter.url_filter(long).collect()] == ["allow"] * 3
    assert time.perf_counter() - began < 10  # 2 s alone
    monkeypatch.setattr(url_filter, "MAPPED_RULES", 0)
    assert sorted(map(tuple, url_filter.url_filter(pages).collect())) == want
