import random
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from cohortlens.llm import quality_rules as Q
from cohortlens.llm.queries import ORACLE_SQL, op5_quality_rules


def brute(text):
    words = [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in text or "").split(" ") if w]
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\v\f\r")]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    many = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if many[w] > 1 for k in range(8)}
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in Q.SYMBOLS for c in text or ""),
        "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "n_stop_words": sum(w.lower() in Q.STOP_WORDS for w in words),
    }


def test_metrics_equal_brute_force(spark):
    random.seed(5)
    texts = [None, "", " \n\t", "one", "a b c d e f g h", "a b c d e f g h " * 2, "x y z 🙂# <é>"]
    texts += ["same line\nsame line\n\n \nother\rline\n", "w " * 3000, "ab" * 100_000]
    for _ in range(120):
        words = random.choices("the of a b cc | # the§ É".split(), k=random.randrange(60))
        texts.append("".join(w + random.choice(" \n\t ") for w in words))
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    for row in Q.judged(df).collect():
        got = row.quality.asDict()
        assert {m: got[m] for m in Q.METRICS} == brute(row.text), row.text
        want = brute(row.text)
        base = want["n_words"] < 20 or 100 * want["n_repeat_words"] > 30 * want["n_words"]
        assert got["base_failed"] == base and (not got["kept"] if base else True)


def test_one_projection_without_python_or_shuffle(spark):
    df = spark.range(3).selectExpr("id", "string(id) as text")
    plan = Q.judged(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_clean_text_stays_and_junk_goes(spark):
    clean = "The house of the river stands near an old bridge and was built by the people of that town in a year."
    junk = ["short", clean.replace(" ", " | "), "stopp nixx worte hier allein " * 2 + "q w e r t z u i o p", "na " * 40]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate([clean, *junk, None])], "doc_id int, text string, quality int")
    kept = Q.kept(df).collect()
    assert [(r.doc_id, r.quality) for r in kept] == [(0, 1)]


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([], "doc_id int, text string, quality string")
    assert Q.judged(df).count() == 0 and Q.kept(df).columns == df.columns


def test_a_rule_table_is_a_parameter(spark):
    df = spark.createDataFrame([("a b",), ("a b c",)], "text string")
    judged = Q.judged(df, base_rules=(), rules=(Q.Rule("few", "n_words", high=2),))
    got = judged.select("text", F.col("quality.failed"), F.col("quality.kept")).collect()
    assert [(r.failed, r.kept) for r in got] == [([], True), (["few"], False)]


def test_query_equals_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{folder}/documents.parquet'")
    want = con.sql(ORACLE_SQL["op5_quality_rules"])
    got = op5_quality_rules(spark, folder).select(want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_text_of_languages_beyond_the_word_list_stays(spark):
    clean = {
        "ru": "Старый дом стоит на берегу реки рядом с мостом, который построили жители города много лет назад, и каждый год туда приезжают гости.",
        "el": "Το παλιό σπίτι βρίσκεται κοντά στο ποτάμι και τη γέφυρα που έχτισαν οι κάτοικοι της πόλης πριν από πολλά χρόνια για όλους τους επισκέπτες.",
        "pl": "Stary dom stoi nad brzegiem rzeki obok mostu, który mieszkańcy miasta zbudowali wiele lat temu, i każdego roku przyjeżdżają tutaj goście z całego świata.",
        "tr": "Eski ev nehrin kıyısında, şehir halkının yıllar önce yaptığı köprünün yanında durur ve her yıl birçok ziyaretçi buraya gelip güzel günler geçirir, sonra yine döner.",
        "zh": " ".join(f"河边的老房子靠近一座桥是城里的人们在很多年以前修建的第{c}" for c in "一二三四五六七八九十百千万亿甲乙丙丁戊己庚辛"),
    }
    finnish = "Vanha talo seisoo joen rannalla sillan vieressä, jonka kaupungin asukkaat rakensivat monta vuotta sitten, ja joka vuosi sinne saapuu paljon iloisia vieraita."
    rows = [(k, t, None) for k, t in clean.items()] + [("fi", finnish, "fi-FI")]
    rows += [("en", finnish, "en"), ("none", finnish, None), ("und", finnish, "und")]
    df = spark.createDataFrame(rows, "k string, text string, lang string")
    assert {r.k for r in Q.kept(df, lang="lang").collect()} == {*clean, "fi"}
    judged = Q.judged(df, lang="lang").where("quality.kept")
    assert {r.k for r in judged.collect()} == {*clean, "fi"}
    assert {r.k for r in Q.kept(df.drop("lang")).collect()} == set(clean)


def test_sql_knows_where_rules_do_not_apply(spark, tmp_path):
    latin = "word and the house of a river in that town with many other things to see for all of us today here now"
    texts = {
        "ru": "слово и дом на реке в этом городе где есть много других вещей для всех нас здесь и сейчас снова опять да нет",
        "pl": "książka źródło łódź gżegżółka śnieg żółw ćma ósmy węgiel pięć świeży mąż dąb gałąź źle święto łąka żaba ćwierć róg",
        "zh": " ".join(["河流经过古老的石头房子和许多其他的东西在这个城市里面"] * 1 + [f"第{i}个很长很长的句子没有空格在里面真的" for i in range(25)]),
        "fi": "talo joki kaupunki asia kaikki muut vanha kivi vesi puu tie koti maa ilma kala lintu metsä saari niitty suo ranta",
        "en": latin,
        None: "xxxx yyyy zzzz qqqq wwww rrrr tttt pppp ssss dddd ffff gggg hhhh jjjj kkkk llll vvvv bbbb nnnn mmmm cccc",
    }
    rows = [(i, t, lang) for i, (lang, t) in enumerate(texts.items())]
    rows += [(10 + i, t, label) for i, t in enumerate(texts.values()) for label in (["und"] if i % 2 else [None])]
    rows += [(20 + i, t, " EN ") for i, t in enumerate(texts.values())]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        want = con.execute(ORACLE_SQL["op5_quality_rules"])
        names = [d[0] for d in want.description]
        want = sorted(want.fetchall())
    got = op5_quality_rules(spark, str(tmp_path))
    assert sorted(got.columns) == sorted(names)
    assert sorted(tuple(r) for r in got.select(names).collect()) == want
    kept = {r[0]: r[names.index("kept")] for r in want}
    assert all(kept[i] for i in range(5)) and not kept[5]
