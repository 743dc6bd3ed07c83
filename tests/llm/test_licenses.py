import random
import re

import pytest
from pyspark.sql import functions as F

from cohortlens.llm import licenses
from cohortlens.llm.queries import op4_licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(lower)


def brute(text):
    words = split(text)
    places, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        wanted = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(wanted)] == wanted:
                places.append(i)
                labels.add(label)
    first, last = (min(places), max(places)) if places else (None, None)
    return len(words), len(places), first, last, sorted(labels)


def pattern(template):
    """The template as a regular expression over words that each end in a space."""
    out, at = "", 0
    for m in licenses._MARKUP.finditer(template):
        out += "".join(re.escape(w) + " " for w in split(template[at : m.start()]))
        at = m.end()
        out += {"beginOptional": "(?:", "endOptional": ")?"}.get(m[1]) or r"(?:\S+ ){%s,%s}" % (m[2], m[3])
    return out + "".join(re.escape(w) + " " for w in split(template[at:]))


def texts():
    random.seed(9)
    parts = "gnu General public LICENSE apache cc-by by mit License, é x 2.0 the under released all rights reserved".split()
    found = [None, "", " .,", "MIT License MIT license", "cc by by cc by", "É mit\x00license ß"]
    found += [" ".join(random.choices(parts, k=random.randrange(40))) for _ in range(300)]
    found += ["mit license " * 50_000, "x" * 300_000 + " apache license"]
    return found


def test_base_equals_brute_force(spark):
    df = spark.createDataFrame(list(enumerate(texts())), "k int, text string")
    for r in df.withColumn("s", licenses.scanned(F.col("text"))).collect():
        s = r.s
        if r.k < 306:
            assert (s.n_words, s.n_base, s.first_word, s.last_word, s.base_labels) == brute(r.text)
        assert set(s.base_labels) <= set(s.labels) and 0 <= s.score <= 1
        assert s.labels == sorted(set(s.labels))


@pytest.mark.parametrize("name", licenses.TEMPLATES)
def test_automaton_accepts_what_the_markup_says(name):
    template = licenses.TEMPLATES[name]
    automaton = licenses.compiled(template)
    wanted = re.compile(pattern(template))
    random.seed(name)
    for _ in range(60):
        text, at = [], 0
        depth_skip = 0
        for m in [*licenses._MARKUP.finditer(template), None]:
            end = m.start() if m else len(template)
            if not depth_skip:
                text += split(template[at:end])
            if m is None:
                break
            at = m.end()
            if m[1] == "beginOptional":
                depth_skip += 1 if depth_skip or random.random() < 0.5 else 0
            elif m[1] == "endOptional":
                depth_skip -= 1 if depth_skip else 0
            elif not depth_skip:
                text += ["filler"] * random.randint(int(m[2]), int(m[3]))
        if random.random() < 0.4 and text:
            text[random.randrange(len(text))] = "changed"
        joined = "".join(w + " " for w in text)
        found = wanted.match(joined)
        end = automaton.longest([w.encode() for w in text], 0)
        assert (end >= 0) == (found is not None), text


def test_optional_replaceable_and_broken_markup():
    a = licenses.compiled("grant <<beginOptional>>to <<var;words=1-2>><<endOptional>> of use")
    ends = [a.longest(t.encode().split(), 0) for t in ("grant of use", "grant to a b of use x", "grant to of use", "grant to a b c of use")]
    assert ends == [3, 6, -1, -1]
    for bad in ("a <<beginOptional>>b", "a<<endOptional>>", "<<var;words=1-2>>", "a <<var;words=3-1>>"):
        with pytest.raises(ValueError):
            licenses.compiled(bad)


def test_extra_columns_and_empty_table(spark):
    df = spark.createDataFrame([("All rights reserved.", 1)], "text string, labels int")
    got = df.withColumn("s", licenses.scanned(F.col("text"))).first()
    assert got.labels == 1 and got.s.labels == ["all-rights-reserved"] and got.s.score == 1.0
    assert df.limit(0).withColumn("s", licenses.scanned(F.col("text"))).collect() == []


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = op4_licenses(spark, folder).collect()
    assert len(got) == len(docs) and any(r.n_base for r in got)
    for r in got:
        n, n_base, first, last, labels = brute(docs[r.doc_id])
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (n, n_base, first, last, ",".join(labels))
        assert set(labels) <= set(r.labels.split(",")) | {""}


def test_license_texts_match_only_to_their_end():
    automata = {name: licenses.compiled(licenses.TEMPLATES[name]) for name in ("mit-text", "isc-text", "bsd-text")}
    for name, automaton in automata.items():
        text = re.sub(r"<<var;[^>]*>>", " holders ", re.sub(r"<<(begin|end)Optional>>", " ", licenses.TEMPLATES[name]))
        whole = split(text)
        label = lambda found: licenses.scan(" ".join(found).encode(), {}, {name: automaton})["labels"]  # noqa: E731, B023
        at = whole.index("liable")
        assert label(whole) == [name] and label(whole[:-1]) == label(whole[: at - 5]) == []
        assert label([*whole[: at + 2], "changed", *whole[at + 3 :]]) == []
