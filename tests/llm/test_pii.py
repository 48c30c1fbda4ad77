"""Plain spans against the rules as single patterns; disguised ones against the source text."""

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from kontor.llm.pii import KINDS, DETECTORS, Transduced, disguised, found_spans, listed, luhn

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute(kind, text):
    out = []
    for m in re.finditer(RULES[kind], text):
        digits = re.sub("[^0-9]", "", m[0])
        good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False,
                "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
        if good:
            out.append(m.span())
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a.@%-+1902 ()é", max_size=60))
def test_detectors_are_the_rules(text):
    for kind in KINDS:
        assert DETECTORS[kind](text) == brute(kind, text), (kind, text)


def test_odd_mail_runs():
    for text in ("a@b.c.d-x%y@e.f", "@a@b.c", "a@@b.c", "a@b@c.d", "a@b.c@d.e", "x@y..z a@b-", "%@b.c"):
        assert DETECTORS["email"](text) == brute("email", text)


def shown(text):
    plain = {k: DETECTORS[k](text) for k in KINDS}
    return {k: [text[a:b] for a, b in v] for k, v in disguised(text, plain).items()}


def test_disguises_map_back_to_the_source():
    assert shown("write to jane.doe [at] mail (dot) example [dot] org now") == {"email": ["jane.doe [at] mail (dot) example [dot] org"]}
    assert shown("mail joe at example dot com please") == {"email": ["joe at example dot com"]}
    assert shown("ｊｏｅ＠ｅｘａｍｐｌｅ．ｃｏｍ") == {"email": ["ｊｏｅ＠ｅｘａｍｐｌｅ．ｃｏｍ"]}
    assert shown("x jоhn@example.com")["email"] == ["jоhn@example.com"]
    assert shown("x jenny@exa​mple.com")["email"] == ["jenny@exa​mple.com"]
    assert shown("ann at mail dot example dot co dot uk!")["email"] == ["ann at mail dot example dot co dot uk"]
    assert shown("call plus four nine three zero one two three four five six seven today") == {
        "phone": ["plus four nine three zero one two three four five six seven"]}
    assert shown("host one nine two dot one six eight dot zero dot one up") == {"ip": ["one nine two dot one six eight dot zero dot one"]}
    assert shown("card ４１１１ １１１１ １１１１ １１１１ end") == {"card": ["４１１１ １１１１ １１１１ １１１１"]}


def test_clean_prose_is_left_alone():
    for text in ("Look at the dot on the map.", "We met at noon. One or two came at six.", "See [a] and (dot) notes.", "Der Punkt ist klar at home"):
        assert shown(text) == {}


def test_rows(spark):
    text = "a@b.co and +49 30 1234567 at 10.0.0.1"
    rows = [(1, text, "x"), (1, text, "x"), (2, None, "y"), (None, "", None), (3, "joe [at] b [dot] co", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = sorted(found_spans(docs).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    base = "email:0:6,phone:11:25,ip:29:37"
    assert [(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.n_added) for r in got] == [
        (1, 1, 1, 0, 1, 0), (1, 1, 1, 0, 1, 0), (2, 0, 0, 0, 0, 0), (3, 0, 0, 0, 0, 1), (None, 0, 0, 0, 0, 0)]
    assert got[0].spans == base and got[0].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    assert got[3].spans == "email:0:19" and got[2].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert found_spans(docs.limit(0)).count() == 0


PIECES = ["+", "1", "49", "415", "0199", "4111", "1111", "plus", "one", "Five", "fünf", "ZÉRO", "un", "ſix", "sıx", "at", "dot", "punkt", "[at]",
          "(\xa0dot )", "<\x0bÄT>", "joe", "mail", "com", "a@b.co", "10.0", "․", "．", "\xad", "\u200b", "о"]


def test_every_disguise_reaches_the_transducer(spark):
    named = ["call +1 415 five five five 0199", "plus one four one five 555 0199", "card four one one one 1111 1111 1111",
             "+49 170 one two three four five six", "joe@example․com", "joe [\xa0at ] mail.com", "joe at mail\xa0dot\xa0com",
             "call +1 415 ſix ſix ſix 0199", "call +1 415 sıx SİX six 0199"]
    random = __import__("random").Random(8)
    made = ["".join(random.choice(PIECES) + random.choice([" ", " ", "-", ", ", "\xa0", ""]) for _ in range(random.randint(1, 14))) for _ in range(6000)]
    texts = named + made
    got = {r.doc_id: r for r in found_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for k, text in enumerate(texts):
        plain = {kind: DETECTORS[kind](text) for kind in KINDS}
        more = disguised(text, plain)
        assert got[k].n_added == sum(map(len, more.values())), text
        assert got[k].spans == listed({kind: plain[kind] + more.get(kind, []) for kind in KINDS}), text
        assert k >= len(named) or got[k].n_added, text


def test_long_blank_runs_take_linear_time():
    assert Transduced("one" + " " * 300_000 + "[at]" + " " * 300_000 + "b").text == "1@b"
