"""Label spaces and ranks."""

# Entities a configuration can name, in finder order.
ENTITIES = (
    "telephone",
    "zipcode",
    "email",
    "fiscal_code",
    "person",
    "organization",
    "address",
    "date",
    "age",
)

# Label written into spans and tags, per entity.
OUTPUT_LABEL = {
    "telephone": "TELEFONO",
    "zipcode": "CAP",
    "email": "E-MAIL",
    "fiscal_code": "CF",
    "person": "PERSONA",
    "organization": "ORGANIZZAZIONE",
    "address": "INDIRIZZO",
    "date": "DATA",
    "age": "ETÀ",
}

# Label of the gold annotations, per entity.
GOLD_LABEL = {
    "telephone": "TEL",
    "zipcode": "ZIP",
    "email": "EMAIL",
    "fiscal_code": "CF",
    "person": "NAME",
    "organization": "ORG",
    "address": "LOC",
    "date": "DATE",
    "age": "AGE",
}

OUTPUT_TO_GOLD = {OUTPUT_LABEL[e]: GOLD_LABEL[e] for e in ENTITIES}

# Gold labels folded into another one before scoring.
GOLD_FOLD = {"YEAR": "DATE"}

# Raw label of an entity-recognition model -> entity.
MODEL_LABELS = {
    "john": {
        "DOCTOR": "person",
        "PATIENT": "person",
        "CITY": "address",
        "HOSPITAL": "organization",
        "E-MAIL": "email",
        "AGE": "age",
        "SSN": "fiscal_code",
        "ZIP": "zipcode",
        "TELEPHONE": "telephone",
    },
    "spacy": {"PER": "person", "LOC": "address", "ORG": "organization"},
    "stanza": {"PER": "person", "LOC": "address", "ORG": "organization"},
}

# Order in which detectors append their spans; it decides ties between spans
# with equal offsets. The three person/organisation/address slots stay empty
# for regular expressions, models come last.
PATTERN_RANK = {"telephone": 0, "zipcode": 1, "email": 2, "fiscal_code": 3, "date": 4, "age": 5}
MODEL_RANK = {"john": 6, "spacy": 7, "stanza": 8}

# Token label of a BIO corpus -> gold label.
BIO_LABEL = {
    "B-AGE": "AGE",
    "B-DOCTOR": "NAME",
    "B-ORGANIZATION": "ORG",
    "B-HOSPITAL": "ORG",
    "B-CITY": "LOC",
    "B-COUNTRY": "LOC",
    "B-DATE": "DATE",
}

# Token labels kept when runs are built. The blank in "I -DATE"
# is part of the value, so by default dates are not extended.
BIO_KEEP = (
    "I-DOCTOR",
    "B-DOCTOR",
    "B-ORGANIZATION",
    "I-ORGANIZATION",
    "B-HOSPITAL",
    "I-HOSPITAL",
    "B-CITY",
    "B-COUNTRY",
    "B-DATE",
    "I -DATE",
    "B-AGE",
)

# Three lines that separate the documents of a raw BIO corpus.
CORPUS_MARKER = "COVID-19 O\n: O\ncaso O\n"

# Dummy lines put around each document of a raw BIO corpus.
CORPUS_HEADER = "TEST_NLP test\n\n"
CORPUS_FOOTER = "\n\nTEST_NLP test"

# Italian month names and abbreviations, in order of replacement.
MONTHS = (
    ("gennaio", "01"),
    ("gen", "01"),
    ("febbraio", "02"),
    ("feb", "02"),
    ("marzo", "03"),
    ("mar", "03"),
    ("aprile", "04"),
    ("apr", "04"),
    ("maggio", "05"),
    ("mag", "05"),
    ("giugno", "06"),
    ("giu", "06"),
    ("luglio", "07"),
    ("lug", "07"),
    ("agosto", "08"),
    ("ago", "08"),
    ("settembre", "09"),
    ("set", "09"),
    ("ottobre", "10"),
    ("ott", "10"),
    ("novembre", "11"),
    ("nov", "11"),
    ("dicembre", "12"),
    ("dic", "12"),
)
