"""Text rules look at a text once: what is repeated in branches and lambdas is bound."""

from pyspark.sql import functions as F

from tidewire.functions import rules, text
from tidewire.operators import stages


def test_a_text_is_lowered_once(spark):
    t = F.lower(F.col("raw_text"))
    rows = spark.sql("SELECT * FROM VALUES ('A noisy pump', 't'), ('a valve', 'u') AS v(raw_text, title)")
    shown = lambda c: rows.where("raw_text <> ''").select(c.alias("x"))._jdf.queryExecution().analyzed().toString().split("\n")[0].count("lower(raw_text")
    keywords = ["pump", "valve", "noise", "ü"]
    assert shown(text.keyword_hits(F.col("raw_text"), keywords)) <= 1
    assert shown(rules.stop_word_reason(t, [("a", keywords)])) == 1
    assert shown(rules.keyword_tag(t, [(1, keywords), (2, ["press"])], 9)) == 1
    assert shown(stages.total_score(t, [(1, 50.0, keywords), (2, 50.0, ["press"])], F.create_map().cast("map<int,double>"))) == 1


def test_keyword_hits_as_with_padded_texts(spark):
    texts = [None, "", "AI", "ai, oil", "said", "for,  the", "for the", "forthe", "x-for the", "for the/", "for - the", "ёлка ЁЛКА", "gas.", "р&d gas", "ai\nai", "for a the", "GAS energie;", "ÄAI ai€"]
    keywords = ["ai", "oil", "gas", "for the", "for  the", " ai", "елка", "&d", "AI", ""]

    def runs(low):
        blank = False
        for c in low:
            inside = c in "abcdefghijklmnopqrstuvwxyz0123456789&/-" or "а" <= c <= "я"
            if inside or not blank:
                yield c if inside else " "
            blank = not inside

    def want(t):
        low = (t or "").lower().replace("ё", "е")
        spaced = f" {''.join(runs(low))} "
        whole = lambda k: k.isascii() and k.replace(" ", "").isalnum()
        return [k for k in keywords if (f" {k} " in spaced if whole(k) else k in low)]

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string").select("id", text.keyword_hits(F.col("t"), keywords).alias("h")).collect()
    assert {r["id"]: r["h"] for r in rows} == {i: want(t) for i, t in enumerate(texts)}
