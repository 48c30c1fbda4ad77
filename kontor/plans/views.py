"""Domain views over the driver tables; one text serves Spark and the SQL oracle.

The tables hold no customers, so customer, company and activity views are derived from part, customer and
events: every source row becomes one view row, cell variants follow from its key.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("nation", "customer", "supplier", "part", "orders", "events", "pages", "documents")
NOW = "2024-01-20 00:00:00"

_WORD = "translate(cast({0} as string), '0123456789', 'abcdefghij')"
_G8 = "(p_partkey - p_partkey % 8)"
_Q = "((p_partkey - p_partkey % 16) % 48)"
_SPREAD = "(p_partkey % 16 >= 8 OR p_partkey % 4 = 0)"
_W8, _WK = _WORD.format(_G8), _WORD.format("p_partkey")

CUSTOMERS = f"""
SELECT p_partkey AS row_no, p_partkey AS "ID",
  CASE WHEN p_partkey % 97 = 5 THEN NULL WHEN p_partkey % 89 = 3 THEN '  '
       WHEN p_partkey % 4 = 0 THEN CASE WHEN p_partkey % 8 = 0 THEN upper(p_name) ELSE '  ' || p_name || ' ' END
       WHEN p_partkey % 16 < 8 THEN CASE WHEN p_partkey % 8 = 1 THEN 'Firma  ~ Handel' WHEN p_partkey % 8 = 2 THEN 'FIRMA ~-handel' ELSE 'Firma ~ Handel' END
       WHEN p_partkey % 8 = 1 THEN 'Firma ~ handel' WHEN p_partkey % 8 = 2 THEN 'Firma ~ handl'
       WHEN p_partkey % 8 = 3 THEN 'Firma ~ hande' WHEN p_partkey % 8 = 5 THEN 'Firma ~ gruppe'
       WHEN p_partkey % 8 = 6 THEN 'Firma ~ grupppe' ELSE 'Firma ~ vertrieb' END AS "KUNDENNAME_RAW",
  {_W8} AS w8,
  CASE WHEN p_partkey % 101 = 7 THEN NULL WHEN p_partkey % 4 = 0 THEN p_brand
       WHEN p_partkey % 8 = 5 AND p_partkey % 48 > 40 THEN 'Anderswo'
       ELSE 'Ort ' || substr('abcdefg', cast({_G8} % 7 + 1 as int), 1) END AS "CITY",
  CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 4 = 0 THEN 'Hauptstr. ' || cast(p_partkey % 30 + 1 as string) || ' a'
       ELSE 'Musterstraße ' || cast({_G8} % 40 + 1 as string) END AS "STRASSE",
  CASE p_partkey % 7 WHEN 0 THEN '01067' WHEN 1 THEN '61462.0' WHEN 2 THEN '61462.5' WHEN 3 THEN '123'
       WHEN 4 THEN ' 60 313' WHEN 5 THEN NULL ELSE '+60311' END AS "PLZ_RAW",
  CASE WHEN {_SPREAD} THEN
         CASE p_partkey % 9 WHEN 0 THEN '030 ' || lpad(cast(p_partkey as string), 6, '4') WHEN 1 THEN '+49 6151 ' || lpad(cast(p_partkey as string), 6, '3')
           WHEN 2 THEN '9 50189' WHEN 3 THEN NULL WHEN 4 THEN '0171 ' || lpad(cast(p_partkey as string), 7, '5') WHEN 5 THEN ''
           WHEN 6 THEN '0221/' || lpad(cast(p_partkey as string), 6, '7') || ' Durchwahl 12' WHEN 7 THEN 'tel:+4144' || lpad(cast(p_partkey as string), 7, '6') ELSE '20260101' END
       WHEN {_Q} = 0 THEN '06151 ' || cast(100000 + {_G8} as string)
       WHEN {_Q} = 16 THEN CASE WHEN p_partkey % 8 IN (1, 2) THEN '06151 ' || cast(100000 + {_G8} as string) END
       ELSE '030 ' || cast(100000 + p_partkey as string) END AS "TELEFON",
  CASE WHEN {_SPREAD} THEN
         CASE p_partkey % 7 WHEN 0 THEN 'info@firma-' || {_WK} || '.de' WHEN 1 THEN 'bad@@mail' WHEN 2 THEN 'noreply@firma.de' WHEN 3 THEN NULL
           WHEN 4 THEN 'test@example.com' WHEN 5 THEN ' Kontakt@Firma-' || {_WK} || '.DE ' ELSE 'verkauf@firma.de' END
       WHEN {_Q} = 0 THEN 'info@firma-' || {_W8} || '.de'
       WHEN {_Q} = 16 THEN CASE WHEN p_partkey % 8 IN (3, 5) THEN 'info@firma-' || {_W8} || '.de' END
       ELSE 'info@firma-' || {_WK} || '.de' END AS "EMAIL",
  CASE WHEN {_SPREAD} THEN
         CASE p_partkey % 11 WHEN 0 THEN 'firma-' || {_WK} || '.de' WHEN 1 THEN 'https://www.firma-' || {_WK} || '.de/' WHEN 2 THEN 'http://firma-' || {_WK} || '.de/start?utm_source=x&a=1&b='
           WHEN 3 THEN 'https://firma.de/info.pdf' WHEN 4 THEN 'https://www.facebook.com/firma' WHEN 5 THEN '' WHEN 6 THEN NULL WHEN 7 THEN 'ftp://firma.de'
           WHEN 8 THEN 'HTTPS://Firma-' || {_WK} || '.de/Pfad/' WHEN 9 THEN 'https://firma.de/a?ref=1#x' ELSE 'https://firma-' || {_WK} || '.de' END
       WHEN {_Q} = 0 THEN 'https://firma-' || {_W8} || '.de'
       WHEN {_Q} = 16 THEN CASE WHEN p_partkey % 8 IN (6, 7) THEN 'https://firma-' || {_W8} || '.de' END
       ELSE 'https://firma-' || {_W8} || '.de' END AS "WEBSITE",
  CASE p_partkey % 8 WHEN 0 THEN 'Vollständig' WHEN 1 THEN ' AKTIV ' WHEN 2 THEN 'Nicht aktiv' WHEN 3 THEN 'Nicht gefunden' WHEN 4 THEN NULL
       WHEN 5 THEN '' WHEN 6 THEN 'nan' ELSE 'aktiv' END AS "STATUS",
  CASE p_partkey % 3 WHEN 0 THEN 'Hoch' WHEN 1 THEN 'Normal' ELSE 'Niedrig' END AS "PRIORITÄT",
  CASE p_partkey % 6 WHEN 0 THEN 'VIP;Messe' WHEN 1 THEN 'messe, alt' WHEN 2 THEN NULL ELSE 'Neu' END AS "TAGS",
  CASE WHEN p_partkey % 5 = 1 THEN '2024-02-01' WHEN p_partkey % 5 = 2 THEN ' ' END AS "NÄCHSTE_WIEDERVORLAGE",
  CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN '2024-01-10T08:00:00' WHEN 2 THEN '2023-11-01T00:00:00' WHEN 3 THEN 'unbekannt' END AS "ANALYZED_AT",
  CASE p_partkey % 4 WHEN 0 THEN 'Sehr gut' WHEN 1 THEN 'Gut' WHEN 2 THEN 'Schwach' ELSE '' END AS "WEBSITE_SCORE_CATEGORY",
  p_partkey % 3 = 0 AS "HAS_IMPRINT", p_partkey % 7 = 0 AS "HAS_OPENING_HOURS",
  CASE WHEN p_partkey % 10 = 9 THEN '' ELSE p_type || ' ' || substr(p_name, 1, 3) END AS "INDUSTRY",
  CASE WHEN p_partkey % 4 = 1 THEN 'facebook, x' ELSE '' END AS "SOCIAL_MEDIA",
  CASE p_partkey % 3 WHEN 0 THEN 'Fehler' WHEN 1 THEN 'Erfolgreich' ELSE '' END AS "ENRICHMENT_STATUS",
  CASE p_partkey % 4 WHEN 0 THEN '2023-12-01 10:00' WHEN 1 THEN '2024-01-19 09:30' WHEN 2 THEN 'kaputt' END AS "LAST_CHECK"
FROM part"""
V_CUSTOMERS = f"""
SELECT row_no, "ID", replace("KUNDENNAME_RAW", '~', w8) AS "KUNDENNAME", "CITY", "STRASSE", "PLZ_RAW" AS "PLZ", "TELEFON", "EMAIL", "WEBSITE",
  "STATUS", "PRIORITÄT", "TAGS", "NÄCHSTE_WIEDERVORLAGE", "ANALYZED_AT", "WEBSITE_SCORE_CATEGORY", "HAS_IMPRINT", "HAS_OPENING_HOURS",
  "INDUSTRY", "SOCIAL_MEDIA", "ENRICHMENT_STATUS", "LAST_CHECK" FROM ({CUSTOMERS}) AS t"""
V_IMPORT = """
SELECT row_no, CASE WHEN row_no % 83 = 11 THEN NULL ELSE "KUNDENNAME" END AS "KUNDENNAME", CASE WHEN row_no % 83 = 11 THEN NULL ELSE "CITY" END AS "CITY",
  CASE WHEN row_no % 83 = 11 THEN NULL ELSE "STRASSE" END AS "STRASSE",
  CASE WHEN row_no % 83 = 11 THEN NULL WHEN row_no % 4 = 0 THEN "PLZ" ELSE '60311' END AS "PLZ", CASE WHEN row_no % 83 = 11 THEN NULL ELSE "TELEFON" END AS "TELEFON",
  CASE WHEN row_no % 83 = 11 THEN NULL ELSE "EMAIL" END AS "EMAIL", CASE WHEN row_no % 83 = 11 THEN NULL ELSE "WEBSITE" END AS "WEBSITE" FROM v_customers"""

_B6 = "(c_custkey - c_custkey % 6)"
_WB, _WC = _WORD.format(_B6), _WORD.format("c_custkey")
_GROUPED = "c_custkey % 6 < 3"
V_COMPANIES = f"""
SELECT c_custkey AS id,
  CASE c_custkey % 6 WHEN 0 THEN 'Kunde ' || {_WB} WHEN 1 THEN 'KUNDE ' || {_WB} WHEN 2 THEN 'kunde-' || {_WB} ELSE c_name END AS company_name,
  CASE WHEN {_GROUPED} THEN 'Ort ' || substr('abcdefg', cast({_B6} % 7 + 1 as int), 1) ELSE n_name END AS city,
  CASE WHEN {_GROUPED} THEN CASE WHEN {_B6} % 4 = 0 OR c_custkey % 6 = 1 THEN 'https://www.kunde-' || {_WB} || '.de/?utm_source=a' ELSE '' END
       WHEN c_custkey % 4 = 0 THEN 'https://kunde-' || {_WC} || '.de/' WHEN c_custkey % 4 = 1 THEN 'https://facebook.com/kunde' WHEN c_custkey % 4 = 2 THEN NULL ELSE 'https://kunde.de/x.pdf' END AS website,
  CASE WHEN {_GROUPED} THEN CASE WHEN {_B6} % 5 = 0 THEN '030 ' || cast(200000 + c_custkey as string) WHEN c_custkey % 6 = 2 THEN '06151 ' || cast(200000 + {_B6} as string) END
       WHEN c_custkey % 5 = 0 THEN '9 50189' WHEN c_custkey % 5 = 1 THEN '' ELSE '+49 171 ' || lpad(cast(c_custkey as string), 7, '5') END AS phone,
  CASE WHEN {_GROUPED} THEN CASE WHEN c_custkey % 6 = 0 THEN 'info@kunde-' || {_WB} || '.de' END WHEN c_custkey % 3 = 0 THEN 'kaputt@firma' ELSE 'info@kunde-' || {_WC} || '.de' END AS email,
  CASE WHEN c_custkey % 6 = 1 THEN 'Max Muster' ELSE '' END AS owner,
  CASE WHEN {_GROUPED} THEN '' WHEN c_custkey % 4 = 0 THEN 'Vollständig' WHEN c_custkey % 4 = 1 THEN 'Aktiv' WHEN c_custkey % 4 = 2 THEN 'Nicht gefunden' ELSE 'Nicht aktiv' END AS status,
  CASE WHEN c_custkey % 7 = 0 AND c_custkey % 6 > 2 THEN NULL ELSE 'Website' END AS source, '2024-01-0' || cast({_B6} % 9 + 1 as string) || ' 10:00' AS last_check,
  CASE WHEN c_custkey % 6 = 2 THEN 'Erika Muster' ELSE '' END AS contact_person, '' AS contact_position,
  CASE WHEN c_custkey % 6 = 0 THEN '0221 ' || cast(300000 + c_custkey as string) ELSE '' END AS direct_phone, '' AS direct_email,
  CASE WHEN {_GROUPED} THEN 'Interessent' WHEN c_mktsegment = 'MACHINERY' THEN 'Kunde' WHEN c_mktsegment = 'HOUSEHOLD' THEN 'Angebot' ELSE 'Interessent' END AS customer_stage,
  CASE WHEN {_GROUPED} THEN 'Normal' WHEN c_acctbal > 5000 THEN 'Hoch' ELSE 'Normal' END AS priority,
  CASE c_custkey % 6 WHEN 0 THEN 'A, b' WHEN 1 THEN 'B;c' WHEN 2 THEN '' ELSE 'x' END AS tags,
  CASE c_custkey % 6 WHEN 0 THEN 'Notiz eins' WHEN 1 THEN 'Notiz zwei' WHEN 2 THEN 'Notiz eins' ELSE NULL END AS notes,
  CASE WHEN c_custkey % 6 < 2 THEN '2024-01-1' || cast(c_custkey % 10 as string) ELSE '' END AS last_contact_at,
  CASE WHEN c_custkey % 6 IN (1, 2) THEN '2024-02-1' || cast(c_custkey % 10 as string) END AS next_follow_up_at,
  '2023-01-01T00:00:00' AS created_at, '2023-06-01T00:00:00' AS updated_at,
  'Musterstraße ' || cast(c_custkey % 40 + 1 as string) AS street, '01067' AS zipcode, '' AS country
FROM customer JOIN nation ON c_nationkey = n_nationkey"""
V_ACTIVITIES = """
SELECT event_id AS id, lower(trim(company_name) || ' ' || trim(city)) AS company_key, CASE WHEN event_id % 5 = 0 THEN NULL ELSE c.id END AS company_id,
  company_name, city, CASE event_type WHEN 'click' THEN 'Telefonat' WHEN 'view' THEN 'E-Mail' WHEN 'purchase' THEN 'Angebot' ELSE 'Notiz' END AS activity_type,
  event_type AS subject, props AS description, replace(substr(cast(ts as string), 1, 16), ' ', 'T') AS occurred_at,
  CASE WHEN event_id % 4 = 0 THEN replace(substr(cast(ts + INTERVAL '3' DAY as string), 1, 16), ' ', 'T') WHEN event_id % 4 = 1 THEN '' END AS follow_up_at,
  replace(substr(cast(ts as string), 1, 19), ' ', 'T') AS created_at
FROM events JOIN v_companies AS c ON user_id = c.id"""
V_RESULTS = """
SELECT o_orderkey AS result_no, coalesce("KUNDENNAME", '') AS company, coalesce("CITY", '') AS city,
  CASE WHEN o_orderkey % 5 = 0 THEN row_no WHEN o_orderkey % 5 = 1 THEN row_no + 100000000 END AS customer_id,
  CASE WHEN o_orderkey % 3 = 0 THEN "STRASSE" WHEN o_orderkey % 3 = 1 THEN 'Nebenweg 99' END AS street,
  CASE o_orderkey % 4 WHEN 0 THEN 'https://neu-' || cast(o_orderkey as string) || '.de/' WHEN 1 THEN coalesce("WEBSITE", 'nan') WHEN 2 THEN '' ELSE 'https://neu.de/x.pdf' END AS website,
  CASE WHEN o_orderkey % 3 = 0 THEN '+49 30 ' || cast(100000 + o_custkey as string) ELSE '' END AS phone,
  CASE WHEN o_orderkey % 3 = 1 THEN 'info@neu-' || cast(o_custkey as string) || '.de' ELSE 'None' END AS email,
  CASE o_orderstatus WHEN 'F' THEN 'Vollständig' WHEN 'O' THEN 'Aktiv' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'Nicht aktiv' ELSE 'Nicht gefunden' END END AS status,
  'Website' AS source, substr(cast(o_orderdate as string), 1, 10) || ' 08:00' AS last_check,
  o_orderkey % 17 <> 0 AS success, CASE WHEN o_orderkey % 19 = 0 THEN 'Zeitüberschreitung' ELSE '' END AS error_message
FROM orders JOIN v_customers ON o_custkey = row_no"""
V_PAIRED = """
SELECT result_no, company, city, website, phone, email, status, success, error_message,
  CASE WHEN result_no % 2 = 0 THEN '' ELSE 'https://neu-' || cast(result_no - result_no % 4 as string) || '.de/' END AS old_website,
  CASE WHEN result_no % 4 < 2 THEN phone ELSE '' END AS old_phone, CASE WHEN result_no % 5 < 2 THEN '' ELSE email END AS old_email,
  CASE WHEN result_no % 7 = 0 THEN '' ELSE status END AS old_status
FROM v_results"""
V_ENRICHMENTS = """
SELECT lower(trim(company_name) || ' ' || trim(city)) || CASE WHEN id % 6 < 3 THEN ' ' || cast(id as string) ELSE '' END AS company_key,
  coalesce(website, '') AS website, id AS company_id, cast(id % 101 as int) AS website_score,
  CASE WHEN id % 5 = 0 THEN '' WHEN id % 5 = 1 THEN 'Hotel' ELSE 'Bäckerei' END AS industry, id % 2 = 0 AS has_imprint, id % 3 = 0 AS has_privacy_policy,
  id % 4 = 0 AS has_opening_hours, id % 5 = 0 AS has_social_media,
  CASE id % 4 WHEN 0 THEN '2024-01-10T08:00:00' WHEN 1 THEN '2023-11-01T00:00:00' WHEN 2 THEN '' ELSE '2024-01-19T23:00:00' END AS analyzed_at,
  CASE WHEN id % 6 = 0 THEN '1.0' ELSE '1.1' END AS analysis_version, CASE WHEN id % 7 = 0 THEN 'Fehler' ELSE 'Erfolgreich' END AS enrichment_status,
  '{"company": "' || company_name || '", "website_score": ' || cast(id % 101 as string) || ', "has_imprint": ' || CASE WHEN id % 2 = 0 THEN 'true' ELSE 'false' END
    || ', "social_media": {"facebook": "' || CASE WHEN id % 5 = 0 THEN 'https://facebook.com/k' ELSE '' END || '"}, "industry": {"industry": "Hotel", "confidence": 0.5}, "enrichment_status": "Erfolgreich"}' AS result_json
FROM v_companies"""
V_CANDIDATES = """
SELECT CASE s_suppkey % 3 WHEN 0 THEN 'Example ' || s_name WHEN 1 THEN 'net Handel ' || s_name ELSE 'the org ' || s_name END AS company_name, 'Ort ' || cast(s_nationkey as string) AS city,
  page_id AS pos, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title
FROM supplier JOIN pages ON s_suppkey = cast((page_id - page_id % 3) / 3 AS bigint)"""

_WS = _WORD.format("s_suppkey")
# Per supplier a small site: start page (with the title of a stored page), contact page, legal notice and privacy page.
V_SITES = f"""
SELECT 4 * k AS page_id, base || '/' AS url, '<html><head><title>Bäckerei ' || w || '</title><meta name="description" content="Unsere Bäckerei bietet täglich frische Backwaren in Berlin an.">'
  || CASE WHEN k % 3 = 0 THEN '<script type="application/ld+json">{{"@type":"Bakery","openingHoursSpecification":[{{"dayOfWeek":["Monday","Tuesday"],"opens":"08:00","closes":"18:00"}}]}}</script>' ELSE '' END
  || '</head><body><h1>Backstube</h1><p>' || title || '</p><p>Telefon: 030 ' || cast(200000 + k as string) || '</p>'
  || CASE WHEN k % 3 = 1 THEN '<p>Montag: 09:00 - 17:00 Mittwoch: geschlossen</p>' ELSE '' END
  || '<a href="/impressum">Impressum</a><a href="/datenschutz">Datenschutz</a><a href="/kontakt#top">Kontakt</a>'
  || CASE WHEN k % 2 = 0 THEN '<a href="https://instagram.com/b' || w || '?utm_source=web">I</a>' ELSE '' END || '</body></html>' AS html FROM site
UNION ALL SELECT 4 * k + 1, base || '/kontakt', '<title>Kontakt</title><form></form><a href="mailto:info@' || host || '">m</a>' FROM site WHERE k % 5 <> 4
UNION ALL SELECT 4 * k + 2, base || '/impressum', CASE WHEN k % 4 = 1 THEN '<html><title>Impressum</title><body><p>Inhaber: Max Muster</p><p>Webdesign: Agentur Schmidt, Hauptstr. 1, 10115 Berlin</p></body></html>' ELSE
  '<html><title>Impressum</title><body><dl><dt>Firma:</dt><dd>Beispiel ' || w || ' GmbH</dd><dt>Anschrift</dt><dd>Musterstr. ' || cast(k % 40 + 1 as string) || ', 01067 Dresden</dd></dl><p>Geschäftsführer: Dr. Max Müller und Erika Muster</p><p>Telefon: 030 '
  || cast(300000 + k as string) || '</p><p>Telefax: 030 999999</p><p>USt-IdNr.: DE ' || cast(100000000 + k as string) || '</p><p>Amtsgericht Dresden, HRB ' || cast(1000 + k as string) || '</p><a href="mailto:webmaster@' || host || '">w</a><a href="mailto:info@' || host || '">m</a></body></html>' END FROM site
UNION ALL SELECT 4 * k + 3, base || '/datenschutz', '<title>Datenschutz</title>' FROM site"""
V_SITE = f"""
SELECT s_suppkey AS k, {_WS} AS w, 'firma-' || {_WS} || '.de' AS host, 'https://firma-' || {_WS} || '.de' AS base, translate(coalesce(regexp_extract(html, '<title>([^<]*)</title>', 1), ''), '0123456789@+', '') AS title
FROM supplier LEFT JOIN pages ON s_suppkey = page_id"""

# Per supplier a site whose pages are linked in a chain: start, legal notice, contact page, branch pages.
V_WALKS = """
SELECT 8 * k AS page_id, base || '/' AS url, '<title>Start</title><a href="/preise">Preise</a><a href="/impressum">Impressum</a>' || CASE WHEN k % 3 = 0 THEN '<a href="/kontakt/start">Wir</a>' ELSE '' END AS html FROM site
UNION ALL SELECT 8 * k + 1, base || '/impressum', '<title>Impressum</title><a href="/impressum">Impressum</a><a href="/kontakt/start">So finden Sie uns</a><a href="/impressum/en#top">English</a>' FROM site WHERE k % 4 <> 1
UNION ALL SELECT 8 * k + 2, base || '/kontakt/start', '<title>Kontakt</title><a href="/">Start</a><a href="mailto:x@' || host || '">Kontakt</a><a href="kontakt/berlin">Berlin</a><a href="/impressum">Impressum</a><a href="kontakt/hamburg">Hamburg</a><a href="kontakt/koeln">Kontakt</a>' FROM site
UNION ALL SELECT 8 * k + 3, base || '/kontakt/berlin', '<title>Berlin</title><p>Telefon: 030 ' || cast(400000 + k as string) || '</p>' FROM site
UNION ALL SELECT 8 * k + 4, base || '/kontakt/hamburg', '<title>Hamburg</title><a href="mailto:info@' || host || '">m</a>' FROM site
UNION ALL SELECT 8 * k + 5, base || '/kontakt/koeln', '<title>Köln</title><p>Telefon: 0221 ' || cast(400000 + k as string) || '</p>' FROM site"""

# Company checks: per supplier a request, often two candidate websites, sometimes a stored company. The first site shows the
# requested address, another house number, none, or another town; the second site is right, not stored, or not offered.
V_REQUESTS = """
SELECT k, 'Firma ' || w AS company_name, 'Dresden' AS city, CASE WHEN k % 5 = 3 THEN '' ELSE 'Lindenweg ' || cast(k % 40 + 1 as string) END AS street, '01067' AS zipcode, '' AS country FROM site"""
V_OFFERS = """
SELECT company_name, city, 2 * k AS pos, 'https://' || host || '/?utm_source=suche' AS url, company_name AS title FROM v_requests JOIN site USING (k) WHERE k % 11 <> 5
UNION ALL SELECT company_name, city, 2 * k + 1, 'https://zwei-' || host || '/', 'Backstube' FROM v_requests JOIN site USING (k) WHERE k % 11 <> 5 AND k % 3 < 2"""
V_OFFER_PAGES = """
SELECT 4 * k AS page_id, 'https://' || host || '/' AS url, '<title>Start</title><p>Telefon: 030 ' || cast(200000 + k as string) || '</p><a href="/impressum">Impressum</a>' AS html FROM site
UNION ALL SELECT 4 * k + 1, 'https://' || host || '/impressum', '<title>Impressum</title><p>wir sind hier: ' || CASE k % 4 WHEN 0 THEN 'Lindenweg ' || cast(k % 40 + 1 as string) || ', 01067 Dresden'
  WHEN 1 THEN 'Lindenweg 99, 01067 Dresden' WHEN 2 THEN 'gleich am Markt' ELSE 'Lindenweg ' || cast(k % 40 + 1 as string) || ', 10115 Berlin' END || '</p>'
  || CASE WHEN k % 2 = 0 THEN '<a href="mailto:info@' || host || '">m</a>' ELSE '' END FROM site
UNION ALL SELECT 4 * k + 2, 'https://zwei-' || host || '/', '<title>Zwei</title><p>Telefon: 0221 ' || cast(600000 + k as string) || '</p><p>wir sind hier: Lindenweg ' || cast(k % 40 + 1 as string) || ', 01067 Dresden</p>' FROM site WHERE k % 3 = 0"""
V_STORED = """
SELECT 1000 + k AS id, company_name, city, CASE WHEN k % 6 = 0 THEN 'Lindenstr. 1' ELSE 'Lindenweg ' || cast(k % 40 + 1 as string) END AS street, 'https://' || host || CASE WHEN k % 4 < 2 THEN '' ELSE '/' END AS website,
  CASE WHEN k % 4 < 2 THEN '030 ' ELSE '+49 30 ' END || cast(500000 + k as string) AS phone, 'info@' || host AS email, 'Max Muster' AS owner, CASE WHEN k % 4 < 2 THEN 'Nicht aktiv' ELSE 'Vollständig' END AS status,
  CASE WHEN k % 4 = 3 THEN '' ELSE 'Website' END AS source, '2024-01-02 10:00' AS last_check FROM v_requests JOIN site USING (k) WHERE k % 6 IN (0, 1)"""

VIEWS = {  # in dependency order
    "v_customers": V_CUSTOMERS, "v_import": V_IMPORT, "v_companies": V_COMPANIES, "v_activities": V_ACTIVITIES,
    "v_results": V_RESULTS, "v_paired": V_PAIRED, "v_enrichments": V_ENRICHMENTS, "v_candidates": V_CANDIDATES,
    "v_site": V_SITE, "v_sites": V_SITES.replace("FROM site", "FROM v_site"),
    "v_walks": V_WALKS.replace("FROM site", "FROM v_site"),
    **{name: text.replace("FROM site", "FROM v_site").replace("JOIN site", "JOIN v_site") for name, text in (
        ("v_requests", V_REQUESTS), ("v_offers", V_OFFERS), ("v_offer_pages", V_OFFER_PAGES), ("v_stored", V_STORED))},
}
_NEEDS = {"v_import": ("v_customers",), "v_activities": ("v_companies",), "v_results": ("v_customers",),
          "v_paired": ("v_results",), "v_enrichments": ("v_companies",), "v_sites": ("v_site",), "v_walks": ("v_site",),
          "v_requests": ("v_site",), "v_offers": ("v_requests",), "v_offer_pages": ("v_site",), "v_stored": ("v_requests",)}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table or a domain view as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = VIEWS[name] if name in ("v_enrichments", "v_sites", "v_walks", "v_offer_pages") else VIEWS[name].replace('"', "`")
    text = text.replace("{", "{{").replace("}", "}}")
    sources = {t: load(spark, sf_dir, t) for t in (*TABLES, *VIEWS) if re.search(rf"\b(?:FROM|JOIN) {t}\b", text)}
    for source in sources:
        text = re.sub(rf"\b(FROM|JOIN) {source}\b", rf"\1 {{{source}}}", text)
    return spark.sql(text, **sources)


@functools.lru_cache(maxsize=None)
def _closure(name: str) -> tuple[str, ...]:
    return tuple(dict.fromkeys([v for need in _NEEDS.get(name, ()) for v in _closure(need)] + [name]))


def with_views(query: str, *names: str) -> str:
    """Oracle text: the query with the definitions of its views in front."""
    wanted = dict.fromkeys(v for n in names for v in _closure(n))
    ctes = ",\n".join(f"{v} AS ({VIEWS[v].strip()})" for v in VIEWS if v in wanted)
    body = query.strip()
    for head in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(head):
            return f"{head}{ctes},\n{body[len(head):]}"
    return f"WITH {ctes}\n{body}"
