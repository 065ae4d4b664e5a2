"""Hosts against published test vectors and the standard library."""

import ipaddress

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mdweave.functions import hosts as H
from mdweave.functions import urls as U

# RFC 3492, section 7.1 (those without upper case), and names that are often shown
NAMES = [
    ("ليهمابتكلموشعربي؟", "xn--egbpdaj6bu4bxfgehfvwxn"),
    ("他们为什么不说中文", "xn--ihqwcrb4cv8a8dqg056pqjye"),
    ("他們爲什麽不說中文", "xn--ihqwctvzc91f659drss3x8bo0yb"),
    ("למההםפשוטלאמדבריםעברית",
     "xn--4dbcagdahymbxekheh6e0a7fei0b"),
    ("почемужеонинеговорятпорусски",
     "xn--b1abfaaepdrnnbgefbadotcwatmq2g4l"),
    ("ひとつ屋根の下2", "xn--2-u9tlzr9756bt3uc0v"),
    ("そのスピードで", "xn--d9juau41awczczp"),
    ("bücher", "xn--bcher-kva"), ("münchen", "xn--mnchen-3ya"), ("faß", "xn--fa-hia"), ("例え", "xn--r8jz45g"), ("テスト", "xn--zckzah"),
    ("☃", "xn--n3h"), ("\U0001f4a9", "xn--ls8h"), ("ü", "xn--tda"), ("BÜCHER", "xn--bcher-kva")]
# WHATWG URL: host parsing
FORMS = [("http://bücher.example/a", "xn--bcher-kva.example"), ("http://2130706433/", "127.0.0.1"), ("http://0x7f.1/", "127.0.0.1"), ("http://0177.0.0.1/", "127.0.0.1"),
         ("http://ex%61mple.com/", "example.com"), ("http://127.0.0.1./", "127.0.0.1"), ("http://192.0x00A80001", "192.168.0.1"), ("http://256.1/", None),
         ("http://1.2.3.4.5/", None), ("http://0x100000000/", None), ("http://4294967295/", "255.255.255.255"), ("http://09.1/", None), ("http://1.2.3.08/", None),
         ("http://0x/", "0.0.0.0"), ("http://foo.0x4", None), ("http://foo.09..", "foo.09.."), ("http://Ｇｏ.com/", "go.com"), ("http://a。b/", "a.b"),
         ("http://a­b/", "ab"), ("http://ex%20ample/", None), ("http://a%zz/", None), ("http://a%c3/", None), ("http://a%C3%BC/", "xn--a-eha"), ("http://%00/", None),
         ("http://[1:2::3]/", "[1:2::3]"), ("http://[0:0:0:0:0:0:0:1]/", "[::1]"), ("http://[::]/", "[::]"), ("http://[1:0:0:2:0:0:0:3]/", "[1:0:0:2::3]"),
         ("http://[1:0:0:2:3:0:0:4]/", "[1::2:3:0:0:4]"), ("http://[::127.0.0.1]/", "[::7f00:1]"), ("http://[::FFFF:1.2.3.4]/", "[::ffff:102:304]"),
         ("http://[1:2:3]/", None), ("http://[1::2::3]/", None), ("http://[12345::]/", None), ("http://[::1.2.3]/", None), ("http://[::1.2.3.256]/", None),
         ("http://[:]/", None), ("http://[1:2:3:4:5:6:7::]/", "[1:2:3:4:5:6:7:0]"), ("http://[:::1]/", None), ("http://[1:2:3:4:5:6:7:8:9]/", None), ("http://[::1/", None),
         ("http://é.com/", None), ("http://a_b.Example/", "a_b.example"), ("http://x.0y/", "x.0y")]


def hosts(spark, urls):
    df = spark.createDataFrame(list(enumerate(urls)), "n int, u string")
    got = {r.n: r.p for r in U.parse_urls(df, "u", "p").select("n", "p").collect()}
    return [got[n].host if got[n].status == "ok" else None for n in range(len(urls))]


def test_published_vectors(spark):
    assert hosts(spark, [f"https://{name}.test/" for name, _ in NAMES]) == [f"{code}.test" for _, code in NAMES]
    assert dict(zip([u for u, _ in FORMS], hosts(spark, [u for u, _ in FORMS]))) == dict(FORMS)


@settings(max_examples=4, deadline=None)
@given(st.lists(st.text("abz09-üß例え\U00020000ж們", min_size=1, max_size=20).filter(lambda t: not t.isascii()), min_size=1, max_size=60))
def test_punycode_is_that_of_the_standard_library(spark, labels):
    df = spark.createDataFrame(list(enumerate(labels)), "n int, t string").selectExpr("n", f"{H.punycode_sql('t')} AS p")
    assert {r.n: r.p for r in df.collect()} == {n: "xn--" + t.encode("punycode").decode() for n, t in enumerate(labels)}


@settings(max_examples=4, deadline=None)
@given(st.lists(st.lists(st.sampled_from([0, 0, 0, 1, 0xff, 0xabcd]), min_size=8, max_size=8), min_size=1, max_size=50), st.integers(0, 2))
def test_ipv6_is_that_of_the_standard_library(spark, every, form):
    def written(groups):
        text = ":".join(f"{g:0{[1, 4, 2][form]}X}" for g in groups)
        return text.replace(":0:0:", "::", 1) if form == 0 and "::" not in text else text

    # (one group of zeros is not shortened, as in the standard)
    df = spark.createDataFrame([(n, written(g)) for n, g in enumerate(every)], "n int, t string").selectExpr("n", f"{H.ipv6_sql('lower(t)')} AS p")
    for r in df.collect():
        value = int.from_bytes(b"".join(g.to_bytes(2) for g in every[r.n]))
        text = written(every[r.n])
        try:
            expected = ipaddress.IPv6Address(text)
        except ValueError:
            assert r.p is None
            continue
        assert int(ipaddress.IPv6Address(r.p)) == int(expected)
        runs = [len(x) // 2 for x in __import__("re").findall("(?:0:)+", ":".join(f"{g:x}" for g in every[r.n]) + ":")]
        if max(runs, default=0) > 1 and int(expected) == value:
            assert "::" in r.p


def test_private_addresses_in_other_forms(spark):
    names = ["::ffff:7f00:1", "::ffff:a00:1", "::ffff:808:808", "::ffff:c0a8:101", "::ffff:ac10:1", "::ffff:ac20:1", "::ffff:a9fe:1", "::ffff:1:1"]
    df = spark.createDataFrame([(h,) for h in names], "h string")
    got = [r.p for r in df.select(U.is_private_hostname(F.col("h")).alias("p")).collect()]
    assert got == [True, True, False, True, True, False, True, True]
