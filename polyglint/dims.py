"""Dimension tables. All values here are fixed by the formats and products they describe."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Finding codes as (code, severity, fixable, title).
CODES = (
    ("syntax", "error", False, "Unparsable file"),
    ("locale", "warning", False, "Locale not checked"),
    ("placeholders", "error", True, "Placeholder mismatch"),
    ("plural", "error", False, "Missing plural form"),
    ("markup", "error", True, "Markup mismatch"),
    ("escape", "error", False, "Android escape"),
    ("array", "error", False, "Array length"),
    ("duplicate", "error", False, "Duplicate key"),
    ("glossary", "error", True, "Glossary"),
    ("empty", "error", True, "Empty translation"),
    ("identical", "warning", False, "Identical to source"),
    ("fragment", "warning", False, "Half translated"),
    ("length", "warning", True, "Length"),
    ("whitespace", "warning", False, "Edge whitespace"),
    ("punctuation", "warning", False, "Punctuation dropped"),
    ("orphan", "warning", False, "Orphan key"),
    ("fuzzy", "warning", False, "Fuzzy"),
    ("state", "warning", False, "Xcode state"),
    ("encoding", "warning", False, "Wrong encoding"),
    ("invisible", "warning", False, "Invisible character"),
    ("link", "warning", False, "Link changed"),
    ("brackets", "warning", False, "Unbalanced brackets"),
    ("entities", "warning", False, "Double-escaped entity"),
    ("inconsistent", "warning", False, "Inconsistent term"),
)
SEVERITY = {c[0]: c[1] for c in CODES}

# CLDR cardinal categories that a language needs; any other language needs one and other.
PLURALS = (
    ("other", "ja ko zh yue vi th id in ms lo km my jv su ig yo wo kea to"),
    ("one few many other", "ru uk be pl lt cs sk"),
    ("one few other", "sr hr bs sh ro mo"),
    ("one two few other", "sl gd dsb hsb"),
    ("zero one two few many other", "ar ars cy kw"),
    ("one two other", "he iw iu naq se sma smi smj smn sms"),
    ("one two few many other", "ga mt br gv"),
    ("zero one other", "lv prg"),
)
REQUIRED = {lang: tuple(cats.split()) for cats, langs in PLURALS for lang in langs.split()}
DEFAULT_REQUIRED = ("one", "other")
CATEGORY_ORDER = ("zero", "one", "two", "few", "many", "other")
# Languages whose `one` also covers 21, 31 ..., so that a count can't be left out there.
COUNT_MANDATORY = frozenset("ru uk be hr sr bs sh lt lv prg".split())

# Gettext plural rules: forms per language, and the category of each msgstr slot by number of forms.
GETTEXT_FORMS = ((1, "ja ko zh vi th id ms lo km my tr"), (3, "ru uk be pl cs sk sr hr bs lt lv ro"), (4, "sl gd"), (5, "ga"), (6, "ar cy"))
GETTEXT_NPLURALS = {lang: n for n, langs in GETTEXT_FORMS for lang in langs.split()}
GETTEXT_LABELS = {1: ("other",), 2: ("one", "other"), 3: ("one", "few", "many"), 4: ("one", "two", "few", "other"), 5: ("one", "two", "few", "many", "other"), 6: ("zero", "one", "two", "few", "many", "other")}

# Words kept in any script, and words that carry no meaning for similarity.
LOANWORDS = (
    "email mail wifi http https www com app web url pdf png jpg gif svg css html json xml api sdk ios android macos "
    "windows linux beta pro plus lite max mini ok px sms gps nfc usb hdmi bluetooth vpn dns ssl tls ssh ftp cpu gpu ram "
    "ssd hdd qr cookie cookies push emoji wiki blog chat bot online offline premium csv zip dark light"
).split()
STOPWORDS = "the a an to of and or in on at for is are be this that these those it its you your we our with from by as do does not no yes can will want sure".split()

# Bracket pairs, and the marks that end a sentence.
BRACKETS = (("(", ")"), ("[", "]"), ("「", "」"), ("『", "』"), ("（", "）"), ("【", "】"))

# The country whose flag stands for a language without a region.
FLAG_OF = dict(
    x.split(":")
    for x in (
        "en:GB de:DE fr:FR es:ES it:IT pt:PT nl:NL ja:JP ko:KR zh:CN ru:RU uk:UA be:BY pl:PL cs:CZ sk:SK hu:HU ro:RO bg:BG el:GR tr:TR ar:SA he:IL iw:IL "
        "fa:IR hi:IN bn:BD th:TH vi:VN id:ID in:ID ms:MY sv:SE da:DK fi:FI nb:NO nn:NO no:NO is:IS et:EE lv:LV lt:LT sl:SI hr:HR sr:RS bs:BA mk:MK sq:AL "
        "ca:ES eu:ES gl:ES ga:IE cy:GB af:ZA sw:KE am:ET ka:GE hy:AM az:AZ kk:KZ uz:UZ mn:MN ur:PK ta:IN te:IN ml:IN kn:IN mr:IN gu:IN pa:IN ne:NP si:LK "
        "my:MM km:KH lo:LA fil:PH tl:PH"
    ).split()
)
# Language names, and what a region or script adds to them.
LANGUAGE_NAMES = dict(
    x.split(":")
    for x in (
        "en:English de:German fr:French es:Spanish it:Italian pt:Portuguese nl:Dutch sv:Swedish da:Danish nb:Norwegian no:Norwegian fi:Finnish pl:Polish "
        "cs:Czech sk:Slovak hu:Hungarian ro:Romanian bg:Bulgarian el:Greek tr:Turkish ru:Russian uk:Ukrainian he:Hebrew iw:Hebrew ar:Arabic fa:Persian "
        "hi:Hindi bn:Bengali th:Thai vi:Vietnamese id:Indonesian in:Indonesian ms:Malay ja:Japanese ko:Korean zh:Chinese ca:Catalan hr:Croatian sr:Serbian "
        "sl:Slovenian lt:Lithuanian lv:Latvian et:Estonian ta:Tamil te:Telugu ur:Urdu sw:Swahili af:Afrikaans fil:Filipino tl:Filipino ga:Irish eu:Basque "
        "gl:Galician is:Icelandic"
    ).split()
)
QUALIFIERS = {
    "zh-hans": "Simplified", "zh-cn": "Simplified", "zh-hant": "Traditional", "zh-tw": "Traditional", "zh-hk": "Traditional", "pt-br": "Brazil", "pt-pt": "Portugal",
    "en-gb": "UK", "en-us": "US", "es-mx": "Mexico", "es-419": "Latin America", "fr-ca": "Canada", "nl-be": "Belgium",
}

STATES = ("new", "edited", "stale", "needs-review", "untranslated", "up-to-date")
FORMATS = ("xcstrings", "android", "json", "arb", "po", "resx", "strings")


def codes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CODES, "code string, severity string, fixable boolean, title string")


def required_categories(spark: SparkSession) -> DataFrame:
    """lang, category for the listed languages: a few hundred rows at most, whatever the data."""
    return spark.createDataFrame([(lang, c) for lang, cats in sorted(REQUIRED.items()) for c in cats], "lang string, category string")
