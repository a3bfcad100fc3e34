"""Word lists, lookup tables, patterns and constants that results depend on."""

# --- fixed values: text -------------------------------------------------------------------
FILLER_WORDS = ["im", "like", "thing", "ok", "got", "youre", "omg", "pls", "tbh", "smh", "aint"]
TOPIC_FILLER_WORDS = ["skin", "skincare"]
CAPTION_STOP_WORDS = [
    "i", "you", "it", "me", "this", "that", "we", "she", "he", "they", "u", "ur",
    "my", "your", "yours", "ours", "their", "its", "use", "like", "get", "need",
    "please", "one", "would", "watch", "want", "que", "tbh", "idk", "fr",
    "literally", "actually", "honestly", "kinda", "thing", "stuff",
]
COMMENT_STOP_WORDS = CAPTION_STOP_WORDS + ["good", "bad"]
URL_OR_MENTION = r"http\S+|www\S+|@[\p{L}\p{N}_]+"
LETTERS = "a-zA-ZäöüÄÖÜß"
EMOTICONS = r"\x{1F600}-\x{1F64F}"
EMOJI_RANGES = (
    r"\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}"
    r"\x{2700}-\x{27BF}\x{1F900}-\x{1F9FF}\x{2600}-\x{26FF}"
)
SLANG = {
    "periodt": "period", "slay": "excellent", "no cap": "no lie", "bussin": "excellent",
    "sheesh": "impressive", "mid": "mediocre", "bet": "yes", "fr": "for real", "ong": "on god",
    "ngl": "not gonna lie", "lowkey": "somewhat", "highkey": "obviously", "vibes": "feelings",
}
NON_INFORMATIVE = [
    r"\blove (this|your|it)\b", r"\bcan (you|u)\b", r"\bthank you\b", r"\bwhat the name\b",
    r"\bwhere can (buy|get)\b", r"\bpls do\b",
]
OFF_TOPIC = ["sagajewels", "jewelry", "collaboration", "collab"]
SPAM_PHRASES = [
    "speed made you famous", "amy made speed", "speed speed", "famous speed made",
    "made speed famous", "speed made", "speed",
]
SPAM_WORD = "speed"

# --- fixed values: dictionaries -----------------------------------------------------------
BRANDS = ["l'oreal", "garnier", "dove", "axe", "rexona", "vaseline", "private label"]
INGREDIENTS = {
    "hyaluronic acid": ["hyaluronic acid", "hyaluronsäure"],
    "glycerin": ["glycerin"],
    "panthenol": ["panthenol"],
    "squalane": ["squalane", "squalan"],
    "aloe vera": ["aloe vera"],
    "niacinamide": ["niacinamide", "niacinamid"],
    "vitamin c": ["vitamin c"],
    "alpha arbutin": ["alpha arbutin", "alpha-arbutin"],
    "licorice root": ["licorice root", "lakritzextrakt"],
    "kojic acid": ["kojic acid", "kojicsäure"],
    "retinol": ["retinol"],
    "peptides": ["peptides", "peptide"],
    "bakuchiol": ["bakuchiol"],
    "coenzyme q10": ["coenzyme q10", "coenzym q10"],
    "ceramides": ["ceramides", "ceramide"],
    "salicylic acid": ["salicylic acid", "salicylsäure"],
    "glycolic acid": ["glycolic acid", "glycolsäure"],
    "lactic acid": ["lactic acid", "milchsäure"],
    "pha": ["pha"],
    "benzoyl peroxide": ["benzoyl peroxide", "benzoylperoxid"],
    "centella asiatica": ["centella asiatica", "tigergras"],
    "green tea": ["green tea", "grüner tee"],
    "allantoin": ["allantoin"],
    "calendula": ["calendula", "ringelblume"],
    "chamomile": ["chamomile", "kamille"],
}
PRODUCTS = {
    "cleanser": ["cleanser", "reiniger", "gesichtsreinigung", "face wash"],
    "toner": ["toner", "gesichtswasser"],
    "serum": ["serum"],
    "essence": ["essence", "essenz"],
    "moisturizer": ["moisturizer", "feuchtigkeitscreme"],
    "sunscreen": ["sunscreen", "sonnencreme"],
    "eye cream": ["eye cream", "augencreme"],
    "exfoliator": ["exfoliator", "peeling"],
    "spot treatment": ["spot treatment", "punktbehandlung"],
    "micellar water": ["micellar water", "mizellenwasser"],
    "night cream": ["night cream", "nachtcreme"],
    "face oil": ["face oil", "gesichtsöl"],
    "mask": ["mask", "maske"],
}
ROUTINE_STEPS = [
    "cleanse", "double cleanse", "toner", "serum", "moisturizer", "eye cream", "sunscreen",
    "exfoliate", "mask", "face massage", "treatment", "essence", "oil", "spot treatment", "primer",
]
TIME_WORDS = [
    ("morning", "morning"), ("am", "morning"), ("night", "night"), ("pm", "night"),
    ("start of the day", "morning"), ("end of the day", "night"), ("evening", "night"),
]
TAG_TOPIC_WORDS = ["skin", "spf", "acne", "moisturizer", "sunscreen", "kbeauty", "glow"]

# --- fixed values: places -----------------------------------------------------------------
COUNTRY_FIX = {
    "Deutschland": "Germany",
    "Österreich": "Austria",
    "UK": "United Kingdom",
    "USA": "United States",
    "Brasil": "Brazil",
    "Italia": "Italy",
    "مصر": "Egypt",
    "المملكة العربية السعودية": "Saudi Arabia",
    "Turkey": "Türkiye",
    "Bangkok 10300 Thailand": "Thailand",
    "Mandarin Oriental Hotel Mandarin Oriental": None,
    "Seongdong Sangwon 2-gil 7-10": None,
}
TIME_ZONES = {
    "Germany": "Europe/Berlin",
    "France": "Europe/Paris",
    "Türkiye": "Europe/Istanbul",
    "Saudi Arabia": "Asia/Riyadh",
    "United States": "America/New_York",
    "Canada": "America/Toronto",
    "Switzerland": "Europe/Zurich",
    "South Korea": "Asia/Seoul",
    "Pakistan": "Asia/Karachi",
    "Indonesia": "Asia/Jakarta",
    "Greece": "Europe/Athens",
    "Philippines": "Asia/Manila",
    "Sweden": "Europe/Stockholm",
    "Kenya": "Africa/Nairobi",
    "Egypt": "Africa/Cairo",
    "South Africa": "Africa/Johannesburg",
    "Austria": "Europe/Vienna",
    "United Kingdom": "Europe/London",
    "Nigeria": "Africa/Lagos",
    "Poland": "Europe/Warsaw",
    "Bangladesh": "Asia/Dhaka",
    "Australia": "Australia/Sydney",
    "Brazil": "America/Sao_Paulo",
    "Colombia": "America/Bogota",
    "United Arab Emirates": "Asia/Dubai",
    "Italy": "Europe/Rome",
    "Czechia": "Europe/Prague",
    "Thailand": "Asia/Bangkok",
    "Mexico": "America/Mexico_City",
    "Nederland": "Europe/Amsterdam",
    "Japan": "Asia/Tokyo",
    "Algeria": "Africa/Algiers",
}

# --- fixed values: labels -----------------------------------------------------------------
TREND_LABELS = ("📉 Dropping", "⏸️ Stable", "📈 Rising")

# --- fixed values: thresholds -------------------------------------------------------------
MIN_CONFIDENCE = 0.65
MAD_SCALE = 1.482602218505602  # 1 / inverse normal cdf of 0.75
VALENCE_NORM = 15.0
