"""Closed vocabularies and fixed lists of the domain (values, not logic)."""

# --- fixed values: column aliases, in lookup order ---------------------------------
NAME, CITY = "KUNDENNAME", "CITY"
PHONE_COLUMNS = ("TELEFON", "PHONE")
EMAIL_COLUMNS = ("EMAIL", "E-MAIL")
WEBSITE_COLUMNS = ("WEBSITE", "URL")
STREET_COLUMNS = ("STRASSE", "STREET", "ADRESSE", "ADDRESS")
POSTAL_COLUMNS = ("ZIPCODE", "ZIP", "POSTALCODE", "POSTCODE", "PLZ", "POSTLEITZAHL")
COUNTRY_COLUMNS = ("LAND", "COUNTRY")
ID_COLUMNS = ("id", "ID", "KUNDEN_ID", "CUSTOMER_ID")

# --- fixed values: words that mean "missing" ----------------------------------------
MISSING_WORDS = ("nan", "none", "<na>", "nat")

# --- fixed values: status and CRM vocabularies --------------------------------------
STATUS_COMPLETE, STATUS_ACTIVE = "Vollständig", "Aktiv"
STATUS_INACTIVE, STATUS_NOT_FOUND = "Nicht aktiv", "Nicht gefunden"
STATUS_FILTERS = {
    "all": None,
    "complete_or_active": ("vollständig", "aktiv"),
    "complete": ("vollständig",),
    "active": ("aktiv",),
    "inactive": ("nicht aktiv",),
    "not_found": ("nicht gefunden",),
    "empty": ("",),
}
CRM_DEFAULTS = {
    "contact_person": "", "contact_position": "", "direct_phone": "", "direct_email": "",
    "customer_stage": "Interessent", "priority": "Normal", "tags": "", "notes": "",
    "last_contact_at": "", "next_follow_up_at": "",
}
CRM_LABELS = {
    "contact_person": "ANSPRECHPARTNER", "contact_position": "POSITION",
    "direct_phone": "DIREKTTELEFON", "direct_email": "DIREKTE_EMAIL",
    "customer_stage": "KUNDENSTATUS", "priority": "PRIORITÄT", "tags": "TAGS",
    "notes": "NOTIZEN", "last_contact_at": "LETZTER_KONTAKT",
    "next_follow_up_at": "NÄCHSTE_WIEDERVORLAGE",
}
ACTIVITY_TYPES = ("Notiz", "Telefonat", "E-Mail", "Termin", "Angebot", "Sonstiges")

# --- fixed values: web lists --------------------------------------------------------
BLACKLISTED_HOSTS = (
    "facebook.com", "instagram.com", "linkedin.com", "youtube.com", "tripadvisor.de",
    "tripadvisor.com", "golocal.de", "11880.com", "gelbeseiten.de", "dasoertliche.de",
    "meinestadt.de", "yelp.com", "yelp.de", "restaurantguru.com", "speisekarte.de",
    "opentable.com", "lieferando.de", "ubereats.com",
)
DOCUMENT_SUFFIXES = (
    ".pdf", ".jpg", ".jpeg", ".png", ".gif", ".webp", ".svg",
    ".zip", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx",
)
TRACKING_PARAMETERS = ("fbclid", "gclid", "ref", "tracking")

# --- fixed values: e-mail rejection lists -------------------------------------------
PLACEHOLDER_EMAILS = (
    "test@example.com", "name@domain.de", "name@example.com", "user@example.com", "demo@example.com")
PLACEHOLDER_DOMAINS = ("example.com", "example.org", "example.net", "domain.de")
PLACEHOLDER_LOCALS = ("test", "name", "demo", "example", "sample", "user")
TECHNICAL_LOCALS = ("webmaster", "noreply", "no-reply", "donotreply")
EMAIL_FILE_SUFFIXES = (".png", ".jpg", ".gif", ".css", ".js")
PREFERRED_MAILBOXES = ("info@", "kontakt@", "contact@", "office@", "hallo@", "mail@")
PHONE_SOURCE_RANK = {"tel": 0, "jsonld": 1, "contact": 2, "imprint": 3, "footer": 4, "text": 5, "snippet": 6}
PHONE_TYPE_RANK = {"fixed": 0, "mobile": 1, "other": 2, "hotline": 3}

# --- fixed values: page analysis ----------------------------------------------------
PAGE_KEYWORDS = {
    "imprint": ("impressum", "anbieterkennzeichnung", "legal-notice", "legal notice"),
    "privacy": ("datenschutz", "privacy-policy", "privacy policy", "privacy"),
    "contact": ("kontakt", "contact"),
    "about": ("über-uns", "ueber-uns", "about-us", "about"),
}
CONTACT_PAGE_KEYWORDS = ("kontakt", "contact", "impressum", "über uns", "ueber uns", "about")
BLOCKED_LINK_TOKENS = ("/login", "/konto", "/account", "captcha")
SOCIAL_DOMAINS = {
    "facebook": ("facebook.com",),
    "instagram": ("instagram.com",),
    "linkedin": ("linkedin.com",),
    "youtube": ("youtube.com", "youtu.be"),
    "tiktok": ("tiktok.com",),
    "x": ("x.com", "twitter.com"),
    "pinterest": ("pinterest.com", "pinterest.de"),
}
SOCIAL_BLOCKED_PATHS = ("", "/", "/login", "/share", "/sharer", "/intent", "/home")
SOCIAL_BLOCKED_TOKENS = ("/share", "/sharer", "/intent", "/login")
SOCIAL_TRACKING = ("fbclid", "gclid", "ref")
WEEKDAYS = ("Montag", "Dienstag", "Mittwoch", "Donnerstag", "Freitag", "Samstag", "Sonntag")
DAY_NAMES = {
    "Montag": ("monday", "mon", "montag", "mo"),
    "Dienstag": ("tuesday", "tue", "dienstag", "di"),
    "Mittwoch": ("wednesday", "wed", "mittwoch", "mi"),
    "Donnerstag": ("thursday", "thu", "donnerstag", "do"),
    "Freitag": ("friday", "fri", "freitag", "fr"),
    "Samstag": ("saturday", "sat", "samstag", "sa"),
    "Sonntag": ("sunday", "sun", "sonntag", "so"),
}
INDUSTRIES = {
    "Restaurant": (("restaurant", "gastronomie", "speisekarte"), ("Restaurant", "FoodEstablishment")),
    "Café": (("café", "cafe", "kaffeehaus"), ("CafeOrCoffeeShop",)),
    "Bäckerei": (("bäckerei", "baeckerei", "backwaren"), ("Bakery",)),
    "Hotel": (("hotel", "zimmer buchen", "übernachtung"), ("Hotel", "LodgingBusiness")),
    "Einzelhandel": (("shop", "geschäft", "einzelhandel"), ("Store",)),
    "Friseur": (("friseur", "haarsalon", "hair salon"), ("HairSalon",)),
    "Autohaus": (("autohaus", "neuwagen", "gebrauchtwagen"), ("AutoDealer",)),
    "Werkstatt": (("werkstatt", "kfz-service", "reparatur"), ("AutoRepair",)),
    "Steuerberatung": (("steuerberater", "steuerberatung", "kanzlei"), ("AccountingService",)),
    "Rechtsanwalt": (("rechtsanwalt", "rechtsanwält", "anwaltskanzlei"), ("Attorney", "LegalService")),
    "Arztpraxis": (("arztpraxis", "praxis", "sprechstunde"), ("Physician", "MedicalClinic")),
    "Apotheke": (("apotheke", "arzneimittel"), ("Pharmacy",)),
    "Bauunternehmen": (("bauunternehmen", "hochbau", "tiefbau"), ("GeneralContractor",)),
    "Immobilien": (("immobilien", "makler", "wohnung verkaufen"), ("RealEstateAgent",)),
    "Versicherung": (("versicherung", "versicherungsagentur"), ("InsuranceAgency",)),
    "Bildung": (("schule", "bildung", "akademie", "seminar"), ("EducationalOrganization",)),
    "Verein": (("verein", "e.v.", "mitgliedschaft"), ("SportsOrganization", "NGO")),
}
SCORE_CRITERIA = (  # key, label, weight; the weights sum to 100
    ("https", "HTTPS", 10), ("ssl", "Gültiges TLS-Zertifikat", 5), ("imprint", "Impressum", 15),
    ("privacy", "Datenschutzseite", 10), ("contact_page", "Kontaktseite", 10),
    ("phone", "Gültiges Telefon", 10), ("email", "Gültige E-Mail", 10),
    ("opening_hours", "Öffnungszeiten", 10), ("social_media", "Social Media", 5),
    ("structured_data", "Strukturierte Daten", 5), ("meta_description", "Meta Description", 5),
    ("valid_website", "Gültige Website", 5),
)
NO_DESCRIPTION = "Keine verlässliche Kurzbeschreibung verfügbar."
ANALYSIS_VERSION = "1.1"
ANALYSIS_MAX_AGE_DAYS = 30
ANALYSIS_MAX_PAGES = 6
CONTACT_MAX_PAGES = 5
DESCRIPTION_MAX_LENGTH = 320
SECONDS_PER_COMPANY = 5
SIMILARITY_THRESHOLD = 90

# --- fixed values: export columns and scopes ----------------------------------------
EXPORT_SCOPES = {
    "visible": None, "complete": "complete", "active": "active", "contactable": "complete_or_active",
    "inactive": "inactive", "not_found": "not_found", "selected": None, "all_loaded": None,
}
STANDARD_COLUMNS = (
    "KUNDENNAME", "CITY", "PLZ", "POSTLEITZAHL", "STRASSE", "STREET",
    "LAND", "COUNTRY", "TELEFON", "EMAIL", "WEBSITE", "STATUS",
)
CRM_COLUMNS = tuple(CRM_LABELS.values())
ENRICHMENT_COLUMNS = (
    "WEBSITE_SCORE", "WEBSITE_SCORE_CATEGORY", "INDUSTRY", "INDUSTRY_CONFIDENCE",
    "OPENING_HOURS", "SOCIAL_FACEBOOK", "SOCIAL_INSTAGRAM", "SOCIAL_LINKEDIN",
    "SOCIAL_YOUTUBE", "SOCIAL_TIKTOK", "SOCIAL_X", "SOCIAL_PINTEREST",
    "HAS_IMPRINT", "IMPRINT_URL", "HAS_PRIVACY_POLICY", "PRIVACY_URL",
    "CONTACT_FORM_URL", "SHORT_DESCRIPTION", "ANALYZED_AT", "ENRICHMENT_STATUS", "ENRICHMENT_ERROR",
    "IMPRINT_OWNER_NAMES", "IMPRINT_MANAGING_DIRECTOR_NAMES", "IMPRINT_REPRESENTATIVE_NAMES",
    "IMPRINT_LEGAL_FORM", "IMPRINT_COMPANY_NAME", "IMPRINT_STREET", "IMPRINT_HOUSE_NUMBER",
    "IMPRINT_POSTAL_CODE", "IMPRINT_CITY", "IMPRINT_COUNTRY", "IMPRINT_PHONE", "IMPRINT_EMAIL",
    "IMPRINT_VAT_ID", "IMPRINT_REGISTER_TYPE", "IMPRINT_REGISTER_NUMBER", "IMPRINT_REGISTER_COURT",
    "IMPRINT_CONFIDENCE", "IMPRINT_ANALYZED_AT",
)
MERGE_FIELDS = ("website", "phone", "email", "owner", "status", "source", "last_check") + tuple(CRM_DEFAULTS)
MERGE_NOT_CONFLICTING = ("tags", "notes", "last_contact_at", "next_follow_up_at")
NOTES_SEPARATOR = "\n\n--- Zusammengeführt ---\n\n"

# --- fixed values: numbering plans ---------------------------------------------------
# Country codes as ITU-T assigns them (E.164), [..] stands for one of several digits.
COUNTRY_CODES = (
    "1 7 20 27 3[0-469] 4[013-9] 5[1-8] 6[0-6] 8[1246] 9[0-58] 21[12368] 22[0-9] 23[0-9] 24[0-9] 25[0-8] 26[0-9] 29[01789] "
    "35[0-9] 37[0-9] 38[0-35-79] 42[013] 50[0-9] 59[0-9] 67[02-9] 68[0-35-9] 69[0-2] 80[08] 85[02356] 88[06] 96[0-8] 97[0-7] 99[2-68]")
# Countries whose national numbers are dialled with a leading 0 that does not belong to the number.
TRUNK_CODES = ("49", "43", "41", "33", "31", "32", "44", "46")
TRUNK_REGIONS = {"DE": "49", "AT": "43", "CH": "41"}
# National plans as the countries' regulators publish them: country, leading digits (all of one length in a row), least
# and most digits of the national number, group sizes (0: the rest), kind. The longest leading digits count.
NUMBER_PLAN = (
    ("49", "15[0-9][0-9]", 11, 11, (4, 0), "mobile"),
    ("49", "16[0-9] 17[0-9]", 10, 11, (3, 0), "mobile"),
    ("49", "800", 10, 10, (3, 0), "hotline"),
    ("49", "180[1-7]", 8, 11, (3, 1, 0), "hotline"),
    ("49", "900[135]", 10, 10, (3, 1, 0), "hotline"),
    ("49", "700", 11, 11, (3, 0), "other"),
    ("49", "32", 11, 11, (2, 0), "other"),
    ("49", "30 40 69 89", 5, 11, (2, 0), "fixed"),
    ("49", "20[1-389] 21[124] 22[18] 23[14] 3[35-9][15] 34[015] 906 2[4-9]1 4[2-9]1 [579][1-9]1 [68][1-8]1", 6, 11, (3, 0), "fixed"),
    ("49", "330[1-467] 332[127-9] 333[124578] 337[1257-9] 338[1256] 339[145] 342[135] 344[13578] 349[1346] 350[14] 352[1-3589] "
           "356[1-4] 357[13468] 358[13568] 362[1-489] 363[124-6] 366[13] 367[12579] 368[1-356] 369[135] 372[1-7] 374[145] "
           "376[1-5] 377[1-4] 3821 383[1468] 386[0-9] 387[1467] 388[136] 390[12479] 392[1358] 394[134679] 396[1-9] 397[136] "
           "398[147] 399[1468]", 6, 12, (4, 0), "fixed"),
    ("49", "3", 7, 12, (5, 0), "fixed"),
    ("49", "[24-9]", 6, 12, (4, 0), "fixed"),
    ("43", "64[0-9] 65[0-3579] 66[013-9] 6[7-9][0-9]", 7, 13, (3, 0), "mobile"),
    ("43", "800 810 820 900 930", 9, 13, (3, 0), "hotline"),
    ("43", "1", 6, 13, (1, 0), "fixed"),
    ("43", "316 463 512 662 732", 7, 13, (3, 0), "fixed"),
    ("43", "[2-7]", 7, 13, (4, 0), "fixed"),
    ("41", "7[5-9]", 9, 9, (2, 3, 2, 2), "mobile"),
    ("41", "800 84[0248] 90[016]", 9, 9, (3, 3, 3), "hotline"),
    ("41", "81 91", 9, 9, (2, 3, 2, 2), "fixed"),
    ("41", "[2-6]", 9, 9, (2, 3, 2, 2), "fixed"),
    ("1", "800 833 844 855 866 877 888 900", 10, 10, (3, 3, 4), "hotline"),
    ("1", "[2-9]", 10, 10, (3, 3, 4), "fixed"),
    ("33", "[1-5]", 9, 9, (1, 2, 2, 2, 2), "fixed"),
    ("33", "[67]", 9, 9, (1, 2, 2, 2, 2), "mobile"),
    ("33", "8", 9, 9, (3, 2, 2, 2), "hotline"),
    ("33", "9", 9, 9, (1, 2, 2, 2, 2), "other"),
    ("39", "02 06", 6, 11, (2, 4, 0), "fixed"),
    ("39", "0", 6, 11, (3, 0), "fixed"),
    ("39", "3", 9, 10, (3, 3, 0), "mobile"),
    ("39", "80", 6, 9, (3, 0), "hotline"),
    ("34", "[89]", 9, 9, (3, 2, 2, 2), "fixed"),
    ("34", "[89]0", 9, 9, (3, 3, 3), "hotline"),
    ("34", "6 7", 9, 9, (3, 2, 2, 2), "mobile"),
    ("31", "6", 9, 9, (1, 0), "mobile"),
    ("31", "1[035] 2[0346] 3[03568] 4[0356] 5[0358] 7[0-9]", 9, 9, (2, 3, 4), "fixed"),
    ("31", "[1-57]", 9, 9, (3, 3, 3), "fixed"),
    ("31", "800 90[0-9]", 7, 10, (3, 0), "hotline"),
    ("31", "8[58]", 9, 9, (2, 3, 4), "other"),
    ("32", "4[5-9]", 9, 9, (3, 2, 2, 2), "mobile"),
    ("32", "4[0-4]", 8, 8, (1, 3, 2, 2), "fixed"),
    ("32", "2 3 9", 8, 8, (1, 3, 2, 2), "fixed"),
    ("32", "1 5 6 7 8", 8, 8, (2, 2, 2, 2), "fixed"),
    ("32", "800 90[0-9]", 8, 8, (3, 2, 3), "hotline"),
    ("352", "6[2-9]1", 9, 9, (3, 3, 3), "mobile"),
    ("352", "[2-9]", 5, 11, (2, 2, 0), "fixed"),
    ("352", "800 90[015]", 8, 8, (3, 0), "hotline"),
    ("44", "20", 10, 10, (2, 4, 4), "fixed"),
    ("44", "2[3489]", 10, 10, (2, 4, 4), "fixed"),
    ("44", "11[3-8] 1[2-69]1", 10, 10, (3, 3, 4), "fixed"),
    ("44", "1", 9, 10, (4, 0), "fixed"),
    ("44", "7[1-57-9]", 10, 10, (4, 6), "mobile"),
    ("44", "3", 10, 10, (3, 3, 4), "other"),
    ("44", "8 9", 9, 10, (3, 3, 0), "hotline"),
    ("48", "45 5[0137] 6[069] 7[2389] 88", 9, 9, (3, 3, 3), "mobile"),
    ("48", "[1-9]", 9, 9, (2, 3, 2, 2), "fixed"),
    ("48", "80[01]", 9, 9, (3, 3, 3), "hotline"),
    ("420", "60 7[02379]", 9, 9, (3, 3, 3), "mobile"),
    ("420", "[2-5]", 9, 9, (3, 3, 3), "fixed"),
    ("420", "8 9", 9, 9, (3, 3, 3), "hotline"),
    ("45", "80 90", 8, 8, (2, 2, 2, 2), "hotline"),
    ("45", "[2-9]", 8, 8, (2, 2, 2, 2), "fixed"),
    ("46", "7[02369]", 9, 9, (2, 3, 2, 2), "mobile"),
    ("46", "8", 7, 9, (1, 3, 3, 0), "fixed"),
    ("46", "[1-69]", 7, 9, (2, 3, 0), "fixed"),
    ("47", "[49]", 8, 8, (3, 2, 3), "mobile"),
    ("47", "[235-7]", 8, 8, (2, 2, 2, 2), "fixed"),
    ("47", "80 82", 8, 8, (3, 2, 3), "hotline"),
    ("351", "2", 9, 9, (3, 3, 3), "fixed"),
    ("351", "9[1236]", 9, 9, (3, 3, 3), "mobile"),
    ("351", "80", 9, 9, (3, 3, 3), "hotline"),
    ("36", "1", 8, 8, (1, 3, 4), "fixed"),
    ("36", "20 3[01] 50 70", 9, 9, (2, 3, 4), "mobile"),
    ("36", "[2-9]", 8, 8, (2, 3, 3), "fixed"),
)
# Any other assigned code: digits of country code and national number together.
OTHER_NUMBERS = (7, 15)

# Words of a legal notice, of written opening hours and of descriptions.
ROLE_WORDS = {
    "owner_names": ("inhaber", "inhaberin", "geschäftsinhaber", "geschäftsinhaberin", "owner", "proprietor"),
    "managing_director_names": ("geschäftsführer", "geschäftsführerin", "geschäftsführung", "managing director", "ceo"),
    "representative_names": ("vertreten durch", "vertretungsberechtigt", "vertretungsberechtigte person", "vorstand", "vorstände",
                             "verantwortlich gemäß", "verantwortlich für inhalt", "verantwortlich für den inhalt"),
}
# Legal forms, the most specific first; words that name a court of registration.
LEGAL_FORMS = ("GmbH & Co. KG", "PartG mbB", "UG (haftungsbeschränkt)", "e.Kfr.", "e.Kfm.", "e.K.", "GmbH", "AG", "GbR", "OHG", "KG", "PartG", "e.V.",
               "Stiftung", "Einzelunternehmen")
COURT_WORDS = ("amtsgericht", "registergericht", "handelsregister AG")
CONTEXT_WORDS = ("hotline", "kontakt", "mobil", "phone", "tel", "telefon", "zentrale")
FAX_WORDS = ("fax", "telefax")
UNRELATED_WORDS = ("datenschutzbeauftrag", "webdesign", "webagentur", "hosting", "hoster", "support", "technischer kontakt",
                   "technischen kontakt", "fax")
FIRM_WORDS = ("firma", "unternehmen", "anbieter", "diensteanbieter", "betreiber")
ADDRESS_WORDS = ("anschrift", "adresse", "sitz", "anbieter", "firma", "unternehmen")
FORM_WORDS = ("firma", "unternehmen", "rechtsform", "anbieter")
TECHNICAL_MAILBOXES = ("datenschutz", "privacy", "support", "webmaster", "hosting")
PHONE_WORDS = ("telefon", "phone", "tel.", "tel")
STREET_WORDS = ("straße", "str.", "weg", "allee", "platz", "gasse", "ring", "ufer")
REGISTER_KINDS = ("HRB", "HRA", "VR", "PR", "GnR")
TAX_WORDS = ("ust", "umsatzsteuer", "vat")
NAME_TITLES = ("Prof.", "Dr.", "Dipl.-")
NAME_JOINS = ("und", "sowie", "&")
RANGE_WORDS = ("-", "–", "bis", "to")
LIST_WORDS = (",", "und", "&")
CLOSED_WORD, APPOINTMENT_WORDS = "geschlossen", "nach vereinbarung"
BARRED_PHRASES = ("cookie", "datenschutz", "jetzt kaufen", "weltweit führend", "der beste")
PRAISE_WORDS = ("führend", "führende", "führender", "führendes", "führenden", "beste", "bester", "bestes", "besten")
