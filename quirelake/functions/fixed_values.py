"""Word lists, weights and maps whose content decides results."""

from __future__ import annotations

# Keyword classes of document types, first hit in this order.
TYPE_KEYWORDS = [
    ("ketubah", ["ketubah", "marriage contract", "wedding"]),
    ("letter", ["letter", "correspondence", "epistle"]),
    ("legal", ["legal", "contract", "deed", "court", "testimony"]),
    ("liturgical", ["prayer", "piyyut", "liturgy", "ritual"]),
    ("talmud", ["talmud", "mishnah", "gemara"]),
    ("bible", ["bible", "biblical", "torah", "scripture"]),
    ("medical", ["medical", "medicine", "remedy", "prescription"]),
    ("business", ["business", "trade", "commercial", "invoice"]),
    ("poetry", ["poem", "poetry", "verse"]),
]
SUMMARY_TYPES = ["talmud", "ketubah", "letter"]
# Title classes of the adapter.
TITLE_KEYWORDS = [("letter", ["letter"]), ("legal", ["legal", "contract"]), ("liturgical", ["liturgical", "prayer"]), ("literary", ["literary", "poem"]), ("list", ["list"])]

# Script by language code, and names of language codes.
SCRIPTS = {"heb": "hebrew", "arc": "aramaic", "jrb": "judeo-arabic", "ara": "arabic", "per": "persian"}
LANGUAGE_NAMES = {"heb": "Hebrew", "jrb": "Judeo-Arabic", "arb": "Arabic", "ara": "Aramaic"}
OTHER_LANGUAGE = "Other"

# Ordered rewrites of shelf marks before prefix matching.
SHELF_MARK_REWRITES = [
    ("MS-TS-AS", "T-S AS"),
    ("MS-TS-NS", "T-S NS"),
    ("MS-TS-K", "T-S K"),
    ("MS-TS-AR", "T-S Ar"),
    ("MS-TS-", "T-S "),
    ("MS-MOSSERI", "Mosseri"),
    ("MS-L-G", "L-G"),
    ("MS-OR-", "CUL Or "),
    ("MS-ADD-", "CUL Add "),
]
SERIES_LETTERS = ["A", "B", "P", "L", "C"]

# Prefix, institution, collection, sub-collection.  Rows whose names a deployment wants worded its own
# way are passed to the operator as a table instead.
SHELF_MARK_PREFIXES = [
    ("T-S", "Cambridge University Library", "Taylor-Schechter", None),
    ("T-S AS", "Cambridge University Library", "Taylor-Schechter", "Additional Series"),
    ("T-S NS", "Cambridge University Library", "Taylor-Schechter", "New Series"),
    ("T-S Ar", "Cambridge University Library", "Taylor-Schechter", "Arabic"),
    ("T-S K", "Cambridge University Library", "Taylor-Schechter", "Miscellaneous"),
    ("CUL Add", "Cambridge University Library", "Additional Manuscripts", None),
    ("ULC Add", "Cambridge University Library", "Additional Manuscripts", None),
    ("CUL Or", "Cambridge University Library", "Oriental Manuscripts", None),
    ("Mosseri", "Cambridge University Library", "Mosseri", None),
    ("L-G", "Cambridge University Library / Bodleian Library Oxford", "Lewis-Gibson", None),
    ("ENA", "Jewish Theological Seminary", "Elkan Nathan Adler", "Main series"),
    ("ENA NS", "Jewish Theological Seminary", "Elkan Nathan Adler", "New Series"),
    ("ENA II", "Jewish Theological Seminary", "Elkan Nathan Adler", "Second Adler acquisition"),
    ("JTS MS", "Jewish Theological Seminary", "General Manuscripts", None),
    ("JTS MS Rabbinica", "Jewish Theological Seminary", "General Manuscripts", "Rabbinic literature from ENA"),
    ("JTS MS Lutzki", "Jewish Theological Seminary", "General Manuscripts", "Biblical texts from ENA"),
    ("JTS Scroll", "Jewish Theological Seminary", "General Manuscripts", "Scrolls from ENA"),
    ("KE", "Jewish Theological Seminary", "Kahle Acquisition", None),
    ("Gaster A", "John Rylands Library, University of Manchester", "Gaster", "Series A"),
    ("Gaster B", "John Rylands Library, University of Manchester", "Gaster", "Series B"),
    ("Gaster P", "John Rylands Library, University of Manchester", "Gaster", "Series P"),
    ("Gaster L", "John Rylands Library, University of Manchester", "Gaster", "Series L"),
    ("Gaster C", "John Rylands Library, University of Manchester", "Gaster", "Series C"),
    ("Gaster Ar", "John Rylands Library, University of Manchester", "Gaster", "Arabic Series"),
    ("Gaster Hebrew MS", "John Rylands Library, University of Manchester", "Gaster", "Hebrew Manuscripts"),
    ("Gaster Hebrew MS Add", "John Rylands Library, University of Manchester", "Gaster", "Hebrew Manuscripts Additional"),
    ("JRL", "John Rylands Library, University of Manchester", "General designation", None),
    ("MS. Heb.", "Bodleian Library, Oxford", "Hebrew Manuscripts", None),
    ("Bodl.", "Bodleian Library, Oxford", "Bodleian Manuscripts", None),
    ("Halper", "University of Pennsylvania, Katz Center", "Dropsie College", None),
    ("CAJS", "University of Pennsylvania, Center for Advanced Judaic Studies", "CAJS", None),
    ("Penn CAJS", "University of Pennsylvania, Center for Advanced Judaic Studies", "CAJS", None),
    ("AIU", "Alliance Israélite Universelle, Paris", None, None),
    ("Kaufmann", "Hungarian Academy of Sciences, Budapest", "David Kaufmann", None),
    ("MS Kaufmann A", "Hungarian Academy of Sciences, Budapest", "David Kaufmann", "Codices"),
    ("DKG", "Hungarian Academy of Sciences, Budapest", "David Kaufmann", None),
    ("BL Or", "British Library, London", "Oriental Manuscripts", None),
    ("BL Add", "British Library, London", "Additional Manuscripts", None),
    ("RNL", "Russian National Library, St. Petersburg", None, None),
    ("Yevr.", "Russian National Library, St. Petersburg", "Evreiskii (Jewish)", None),
    ("Dropsie", "University of Pennsylvania (formerly Dropsie College)", "Dropsie", None),
]
PARIS_INSTITUTION = "Alliance Israélite Universelle, Paris"

# Institution and repository by a word in the URL, and by a word in an unmapped shelf mark.
URL_INSTITUTIONS = [
    (["cambridge"], "Cambridge University", "Cambridge University Library"),
    (["princeton"], "Princeton University", None),
    (["penn"], "University of Pennsylvania", None),
]
MARK_INSTITUTIONS = [
    (["Manchester"], "Rylands", "John Rylands Library"),
    (["Paris", "AIU"], "Paris", "Alliance Israélite Universelle"),
    (["Cambridge"], "Cambridge University", "Cambridge University Library"),
    (["Bodleian", "Oxford"], "Oxford University", "Bodleian Library"),
    (["JTS", "Jewish Theological Seminary"], "Jewish Theological Seminary", "JTS Library"),
]

# Search fields with their boosts, and BM25 constants.
SEARCH_BOOSTS = [("description", 2.0), ("full_text_content", 1.0), ("transcriptions", 1.0), ("translations", 1.0)]
BM25_K1, BM25_B = 1.2, 0.75

# Consensus of transcription models.
OCR_CONFIDENCE, REVIEW_SIMILARITY = 0.7, 0.90
CONSENSUS_SCORES = {"both": 0.82, "pro": 0.80, "flash": 0.75, "fallback": 0.50}
