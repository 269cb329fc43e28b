"""The spans that the random field and the entropy scan add: precision, recall, whole texts."""

import random
import re
import string
import time

import pyarrow as pa
import pytest

from pathloom.llm import arrowtext as at
from pathloom.llm import pii, secrets

SF = "/root/testdata/sf0.001"

#: Lines that aren't trained on; spans in double brackets, with their kind.
HELD = (
    "please write to [[email:greta.olsen [at] firm [dot] example]] for the file",
    "you can mail [[email:h.kato (at) lab.example.org]] at any hour",
    "questions go to [[email:desk42 [at] press [dot] example [dot] net]] until May",
    "reports: [[email:noor (at) clinic (dot) org]], thanks",
    "try [[email:bob AT corp DOT com]] or wait",
    "or ask [[email:li.wei AT team DOT example DOT edu]] first",
    "reply to [[email:eva.k@mail.example.com]] today",
    "please call [[phone:0171 234 56 78]] after six",
    "my line is [[phone:(212) 555-0187]], leave a note",
    "ring [[phone:312-555-0164]] if it rains",
    "text [[phone:718.555.0139]] when you land",
    "her desk, [[phone:(040) 555-7788]], rings all day",
    "phone [[phone:702 555 0171]] for a table",
    "from abroad [[phone:0033 6 55 01 02 03]] works",
    "mobile [[phone:0176 555 33 21]] is new",
    "fax [[phone:020-5557-9911]] too",
    "dial [[phone:+81 3 5550 1234]] now",
    "the card [[card:5105.1051.0510.5100]] was stopped",
    "use [[card:4222 2222 2222 2220]] to test",
    "old card [[card:3714 496353 98431]] is void",
    "he gave [[card:6011/0009/9013/9424]] by mistake",
    "paid by [[card:5555-5555-5555-4444]] last week",
    "login from [[ip:192[.]0[.]2[.]33]] refused",
    "blocked [[ip:198 . 51 . 100 . 14]] again",
    "node [[ip:10[.]1[.]20[.]7]] is down",
    "gateway [[ip:172.31.0.1]] is up",
    "the census of 1881 counted 34,884,848 people",
    "open 9:00-17:30, closed on 24.12. and 31.12.2025",
    "born 1984-06-12, moved 03/04/2011",
    "it weighs 12.5 kg and costs 1,499.99 a piece",
    "chapters 3.2 to 3.2.1.4 cover 250 pages",
    "release 2.14.0 fixes bugs 1021, 1044 and 1050",
    "the score was 21-19, 18-21, 21-17",
    "isbn 978-0-306-40615-7 was reprinted",
    "order 4471120938 shipped in 2 boxes",
    "flight LH 454 leaves gate B42 at 10:05",
    "we sat (at) the pier and @ the bar",
    "WE MEET AT DAWN. DOT THE LINES",
    "scale 1:25000, sheet 5530-12",
    "serial 00-14-22-01-23-45 of 2019",
    "GDP rose 2.3 % in 2017, 1.9 % in 2018 and 0.4 % in 2019",
    "version 4.0 of the licence, section 2.1(a)(1)",
    "results 10 20 30 40 50 60 70 80 90 100",
    "the ratio is 3.14159265 to 2.71828182",
)


def unmarked(line):
    text, spans = "", set()
    for piece in re.split(r"(\[\[\w+:.*?\]\](?!\]))", line):
        m = re.fullmatch(r"\[\[(\w+):(.*)\]\]", piece)
        body = m[2] if m else piece
        if m:
            spans.add((len(text), len(text) + len(body), m[1]))
        text += body
    return text, spans


def test_the_held_out_table_is_not_trained_on():
    assert not set(HELD) & set(pii.LABELLED)


def test_precision_and_recall_on_held_out_lines():
    right = {k: 0 for k in pii.KINDS}
    made, asked = dict(right), dict(right)
    for line in HELD:
        text, want = unmarked(line)
        base, every = pii.all_spans([text])[0]
        got = set(every) - (set(base) - want)  # what the patterns find is asked for by their definition
        for made_or_asked, spans in ((made, got), (asked, want), (right, got & want)):
            for _, _, kind in spans:
                made_or_asked[kind] += 1
    assert sum(right.values()) >= 0.9 * sum(made.values()) and sum(right.values()) >= 0.9 * sum(asked.values())
    assert all(right[k] >= 0.8 * asked[k] for k in pii.KINDS), (right, asked)


def test_the_field_finds_the_same_in_whole_texts(spark):
    """What the field reads around triggers is enough: reading all of a text adds the same spans."""
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(150).collect()]
    texts += [" ".join(unmarked(line)[0] for line in HELD)]
    near = pii.all_spans(texts)
    whole, reach = pii.stretches, 1 << 40
    pii.stretches = lambda text: whole(text, reach)
    try:
        assert pii.all_spans(texts) == near
    finally:
        pii.stretches = whole


@pytest.mark.parametrize("text", ["x@" + "a." * 50_000 + "a foo", "a [at] b" + " " * 50_000 + "[dot] c", "(at) " * 20_000, "1 " * 30_000, "AT DOT " * 10_000])
def test_long_odd_texts_take_linear_time(text):
    began = time.time()
    pii.all_spans([text])
    assert pii._holds("email", text) in (True, False) and time.time() - began < 30


@pytest.mark.parametrize(("address", "holds"), [
    ("bob AT corp DOT com", True), ("bob [at] corp [dot] com", True), ("a (AT) b.c", True), ("bob at corp dot com", False),
    ("bob AT corp", False), ("@b.c", False), ("a@b.", False), ("a@b. c", True), ("a b@c.d", False), ("kim AT corp.example", True),
])
def test_addresses_need_a_sign_and_a_dot(address, holds):
    assert pii._holds("email", address) is holds


SIGNS = {"base62": string.ascii_letters + string.digits, "base64": string.ascii_letters + string.digits + "+/", "base36": string.ascii_lowercase + string.digits, "hex": string.digits + "ABCDEF"}


@pytest.mark.parametrize(("signs", "size", "least"), [("base62", 20, 0.85), ("base62", 32, 0.95), ("base64", 24, 0.9), ("base64", 40, 0.95), ("base36", 32, 0.9), ("base36", 20, 0.65), ("hex", 24, 0.9)])
def test_random_tokens_are_found_by_entropy(signs, size, least):
    random.seed(5)
    tokens = ["".join(random.choices(SIGNS[signs], k=size)) for _ in range(400)]
    got = secrets.all_spans(at.Texts(pa.array([f"see {t} there" for t in tokens], pa.string())))
    assert sum(any(kind == "entropy" for _, _, kind in every) for _, every in got) >= least * len(tokens)


def test_names_and_paths_are_no_secrets():
    clean = ["usr/local/lib/python3/site-packages/numpy2", "max_denominator_of_10000", "cpython-313-x86_64-linux", "2001-09-11T08-46-00-05", "abcdefghijklmnopqrstuvwxyz0123456789",
             "Modules/socket/issues/86361", "IMAP4_server_hostname_2", "a" * 30 + "1", "plain words only", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"]
    assert all(not every for _, every in secrets.all_spans(at.Texts(pa.array(clean, pa.string()))))
