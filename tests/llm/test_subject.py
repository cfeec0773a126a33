import base64
import random

import numpy as np

from loomspan.llm import mail, subject

OWN = "Hello,\n\nThe goat ate the hay. We fed the goat.\n\nBest,\nAna\n"


def test_bodies_and_encodings():
    head = "From: Ana B <ana.b@x.example>\nSubject: s\n"
    plain = head + "\n" + OWN
    b64 = head + "Content-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: base64\n\n" + base64.b64encode(OWN.encode()).decode() + "\n"
    qp = head + "Content-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: quoted-printable\n\n" + OWN.replace("goat.", "go=\nat.") + "\n"
    multi = head + 'Content-Type: multipart/mixed;\n boundary="q"\n\nskip\n--q\nContent-Type: text/plain\n\n' + OWN + '\n--q\nContent-Type: text/plain; name="a.txt"\nContent-Disposition: attachment\n\nThe court ruled.\n--q--\n'
    page = head + "Content-Type: text/html\n\n<p>The goat ate the hay. We fed the goat.</p><blockquote>The court ruled on it.</blockquote>\n"
    for raw in (plain, b64, qp, multi, page, plain.replace("\n", "\r\n"), "From x@y Mon\n" + plain):
        said = mail.own_sentences(raw)
        assert "The goat ate the hay." in said and "We fed the goat." in said and not any("court" in s for s in said)
    assert mail.own_sentences("") == [] and mail.own_sentences("no headers here. Only text.") == ["no headers here.", "Only text."]


def test_quotes_forwards_and_notices():
    own = "From: Ana B <ana.b@x.example>\n\n"
    quoted = own + "We fed the goat.\n\nOn Mon, Bo wrote:\n> The court ruled\nand adjourned.\n> So be it.\n"
    below = own + "We fed the goat.\n\nBest,\nAna\n\n-----Original Message-----\nFrom: Bo C\nSubject: s\n\nThe court ruled.\n\nBo\n"
    above = own + "-----Original Message-----\nFrom: Bo C\nSubject: s\n\nHello,\n\nThe court ruled.\n\nBest,\nBo\n\nDear Bo,\n\nWe fed the goat.\n\nAna\n"
    gap = own + "-----Original Message-----\nFrom: Bo C\nSubject: s\n\nThe court ruled.\n\n\nWe fed the goat.\n\nAna\n"
    legal = own + "We fed the goat.\n\nAna\n\n____\nCONFIDENTIALITY NOTICE: the court ruled that copying is prohibited.\n"
    for raw in (quoted, below, above, gap, legal):
        said = mail.own_sentences(raw)
        assert "We fed the goat." in said and not any("court" in s for s in said), raw


WORDS = {s: [f"{s[:3]}{a}{b}" for a in ("ba", "ke", "li", "mo") for b in ("na", "ro", "si", "tu", "ve")] for s in ("farming", "law", "music")}
FRAMES = ["We {0} the {1} before the {2} came up again.", "Please look at the {0} first; the {1} and the {2} can follow.", "After a week the {0} still depends on the {1} and the {2}."]


def test_held_out_accuracy(spark):
    rnd = random.Random(5)
    docs, truth = [], {}
    for i in range(900):
        about = rnd.sample(sorted(WORDS), rnd.choice([0, 1, 1, 1, 2]))
        said = [rnd.choice(FRAMES).format(*rnd.sample(WORDS[s], 3)) for s in about for _ in range(3)] + ["Could you confirm the room for Thursday?", "Thanks a lot for the quick reply."]
        docs.append((i, f"From: P{i % 7} <p@x.example>\n\n" + " ".join(said) + "\n", "en", "x"))
        truth[i] = set(about)
    docs += [(900, None, None, "x"), (901, "", "en", "x"), (902, "  \n", "EN", "x"), (903, docs[0][1], None, "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, subject string")
    known = [(i, rnd.choice(sorted(truth[i]))) for i in range(0, 900, 5) if truth[i]] + [(1, "unheard-of")]
    labels = spark.createDataFrame(known, "doc_id long, subject string")
    got = {}
    for r in subject.subject_areas(df, labels, sorted(WORDS)).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    right = sum(got.get(i, set()) == truth[i] for i in range(900) if i % 5)
    assert right / 720 > 0.97 and not {900, 901, 902} & set(got)
    assert subject.subject_areas(df.limit(0), labels, sorted(WORDS)).count() == 0
    assert subject.subject_areas(df, labels.limit(0), sorted(WORDS)).count() == 0


def test_languages_of_few_documents(spark):
    """Ten labelled documents of one language among 1,500 documents of another."""
    rnd = random.Random(6)

    def said(tag, s):
        return " ".join(rnd.choice(FRAMES).format(*(tag + w for w in rnd.sample(WORDS[s], 3))) for _ in range(3))

    names = sorted(WORDS)
    docs = [(i, f"From: P <p@x.example>\n\n{said('', names[i % 3])} Could you confirm the room for Thursday?\n", "en") for i in range(1500)]
    few = [(2000 + i, f"From: P <p@x.example>\n\n{said('zz', names[i % 3])}\n", "zz") for i in range(18)]
    truth = {2000 + i: names[i % 3] for i in range(18)}
    df = spark.createDataFrame(docs + few, "doc_id long, text string, lang string")
    known = [(i, names[i % 3]) for i in range(0, 1500, 5)] + [(2000 + i, names[i % 3]) for i in range(10)]
    labels = spark.createDataFrame(known, "doc_id long, subject string")
    got = {r.doc_id: r.subject for r in subject.subject_areas(df, labels, names).filter("doc_id >= 2000").collect()}
    assert sum(got.get(k) == v for k, v in truth.items()) >= 15


def test_weights_do_not_fall_with_the_size():
    """Terms with the same shares bear as much in a corpus 78 or 10,000 times as large."""
    n = 600_000
    frequency = np.array([n / 20, n / 40, n / 200, n / 2000, n / 2000])
    counts = np.diag(frequency)[:, :4]
    counts[4] = counts[:4].sum(0) / 100  # falls evenly on the subjects
    at = subject._weights(counts, frequency, n)
    assert (at[:4] >= subject.BEARING).all() and at[4] < 0.01
    for k in (78, 10_000):
        assert np.allclose(subject._weights(counts * k, frequency * k, n * k), at, atol=0.02)


def test_subjects_of_a_corpus_many_times_as_large(spark, monkeypatch):
    """The weights are made as for 100,000 copies of the documents, which have the subjects of one copy."""
    names, k, real = sorted(WORDS), 100_000, subject._weights
    rnd = random.Random(7)
    docs = [(i, f"From: P <p@x.example>\n\n{' '.join(rnd.choice(FRAMES).format(*rnd.sample(WORDS[names[i % 3]], 3)) for _ in range(3))} Could you confirm the room for Thursday?\n", "en") for i in range(600)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, names[i % 3]) for i in range(0, 600, 4)], "doc_id long, subject string")
    monkeypatch.setattr(subject, "_weights", lambda counts, frequency, n: real(counts * k, frequency * k, n * k))
    got = {(r.doc_id, r.subject) for r in subject.subject_areas(df, labels, names).collect()}
    assert len(got & {(i, names[i % 3]) for i in range(600)}) > 0.97 * 600
