"""Literal rows per scalar function."""

import pytest
from pyspark.sql import functions as F

from kontor.functions import address as A
from kontor.functions import contacts as C
from kontor.functions import text as T
from kontor.functions import web as U


def column(spark, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[1] for r in df.select("i", make(F.col("v")).alias("r")).orderBy("i").collect()]


def staged(spark, values, stage, out="r"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in stage(df, F.col("v"), out).orderBy("i").select(out).collect()]


def test_phones(spark):
    good = ["06151 123456", "+49 6151 123456", "0049 6151 123456", "06151/123456", "tel:+496151123456"]
    assert staged(spark, good, C.with_phone) == ["+49 6151 123456"] * 5
    assert staged(spark, ["06151 123456 Durchwahl 42"], C.with_phone)[0].endswith("ext. 42")
    bad = ["9 50189", "123", "010101010101", "0000000000", "20260101", "60311", "12:30", "19,99", None, "+33 1 23 45 67"]
    assert staged(spark, bad, C.with_phone) == [""] * len(bad)


def test_phone_context(spark):
    df = spark.createDataFrame([("030 123456", "text", "ruf an"), ("030 123456", "text", "Telefon: "), ("030 123456", "tel", ""),
                                ("030 123456", "text", "Telefax Telefon")], "v string, s string, c string")
    out = C.with_phone(df, F.col("v"), "p", source=F.col("s"), context=F.col("c"), require_context=F.lit(True))
    assert [r.p_reason for r in out.collect()] == ["kein Telefonkontext", "", "", "Faxnummer"]


def test_emails(spark):
    assert column(spark, [" Info@Example-Company.de", "kontakt@firma.de"], C.email) == ["info@example-company.de", "kontakt@firma.de"]
    bad = ["test@example.com", "noreply@firma.de", "info@", "@firma.de", "kaputt@firma", "a@b@c.de", None, "bild@x.png"]
    assert column(spark, bad, C.email) == [""] * len(bad)


def test_status(spark):
    df = spark.createDataFrame([("w", True, True), ("w", True, False), ("w", False, False), (" ", True, True)], "w string, p boolean, e boolean")
    assert [r[0] for r in df.select(C.contact_status(F.col("w"), F.col("p"), F.col("e"))).collect()] == [
        "Vollständig", "Aktiv", "Nicht aktiv", "Nicht gefunden"]


def test_urls(spark):
    given = ["https://x.de/menu.pdf?utm_source=x", "https://x.de/logo.png", "https://x.de/start?utm_source=x", "https://www.facebook.com/a",
             "http://m.facebook.com/q", "x.de", "https://x.de/a?b=1&c=&d=a%20b"]
    assert staged(spark, given, U.with_clean_url) == [
        "https://x.de/", "https://x.de/", "https://x.de/start", "", "http://m.facebook.com/q", "", "https://x.de/a?b=1&d=a+b"]
    assert staged(spark, ["example.de", "http://example.de/", "https://x.de/info.pdf"], U.with_website) == ["https://example.de", "http://example.de", ""]


def test_postal_codes(spark):
    given = ["61462.0", "60313", "01067", None, "NaN", "61462.5", "61462,0", " 60 313 ", "+123", "D-12"]
    assert column(spark, given, A.normalize_postal_code) == ["61462", "60313", "01067", "", "", "61462.5", "61462", "60313", "123", "D-12"]


@pytest.mark.parametrize("left,right,state", [
    ("Musterstraße 12", "Musterstr. 12", "match"), ("Musterstraße 12 A", "Musterstrasse 12a", "match"), ("Musterstraße 12", "Musterstraße 14", "conflict"),
    ("Musterstraße 12", "Nebenweg 12", "conflict"), ("", "Nebenweg 1", "match"), ("Musterstraße 1", "", "missing")])
def test_streets(spark, left, right, state):
    df = spark.createDataFrame([(left, right)], "a string, b string")
    assert df.select(A.street_match(F.col("a"), F.col("b"))).first()[0] == state


def test_text(spark):
    assert column(spark, ["  Müller   GmbH", "müller gmbh", "ＭÜLLER　GMBH", "Straße & Söhne", None], T.norm_name) == [
        "müller gmbh", "müller gmbh", "müller gmbh", "strasse söhne", ""]
    assert column(spark, ["nan", " None ", "<NA>", "NaT", "x "], T.clean_missing) == ["", "", "", "", "x"]
    assert column(spark, ["  Müller GmbH "], lambda c: T.company_key(c, F.lit(" Köln "))) == ["müller gmbh köln"]
    assert column(spark, ["abc", ""], T.deletion_signatures) == [["abc", "bc", "ac", "ab"], [""]]
    assert column(spark, ["Müller"], lambda c: T.maps_url(c, F.lit(None), F.lit(" 1 "), F.lit("Köln"), F.lit("")))[0].endswith("M%C3%BCller%2C%201%2C%20K%C3%B6ln")


def test_address_state(spark):
    df = spark.createDataFrame([(1,)], "i int")
    place = lambda s, z, c: F.struct(F.lit(s).alias("street"), F.lit(z).alias("zipcode"), F.lit(c).alias("city"))
    state = lambda *p, street="Musterstr. 1", match=True: df.select(A.address_state(
        F.lit(street), F.lit("01067"), F.lit("Dresden"), F.array(*p), match)).first()[0]
    assert state(place("Musterstraße 1", "01067", "Dresden Neustadt")) == "match"
    assert state(place("Musterstraße 1", "99999", "Dresden")) == "conflict"
    assert state(place("Nebenweg 1", "", ""), place("", "", "")) == "missing"
    assert state(place("Nebenweg 1", "", "")) == "conflict"
    assert state(place("Nebenweg 1", "", ""), match=False) == "match"
    assert state(place("Nebenweg 1", "", ""), street="") == "match"
