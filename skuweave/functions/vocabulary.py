"""Fixed values of product matching: vocabularies, keys and patterns that results depend on."""

from __future__ import annotations

# Specification keys that hold barcodes, ASINs, brands, models and sizes, in the order they are looked at.
EAN_KEYS = ["GTIN", "EAN-Code", "EAN", "GTIN/EAN", "ean", "gtin", "ean13", "barcode", "mpn"]
ASIN_KEYS = ["ASIN", "asin"]
BRAND_KEYS = ["Marke", "Brand", "Hersteller", "brand", "manufacturer"]
MODEL_KEYS = [
    "Hersteller Modellnummer", "Hersteller Artikelnummer", "Modellnummer", "Modellname", "Model", "Model Number",
    "Herstellernummer", "Artikelnummer", "Modellkennzeichen",
]
SIZE_KEYS = [
    "Bildschirmdiagonale", "Bildschirmdiagonale (cm/Zoll)", "Bildschirmdiagonale in cm, Zoll", "Größe", "Fassungsvermögen",
    "Kabellänge", "Länge", "Abmessungen", "Produktabmessungen",
]

# Words that say nothing about a product, by place.
NAME_STOPWORDS = [
    "and", "bei", "cm", "das", "der", "die", "ein", "eine", "fuer", "für", "full", "hd", "im", "in", "mit", "of", "ohne",
    "pro", "smart", "tv", "the", "und", "von", "zoll",
]
RETAILER_TOKENS = ["amazon", "cyberport", "electronic4you", "e-tec", "etec", "expert", "mediamarkt"]
COMPANY_FORMS = ["gmbh", "inc", "ag", "ltd", "electronics"]
KNOWN_BRANDS = [
    "aeg", "apple", "beurer", "bose", "bosch", "braun", "chiq", "cosori", "delonghi", "delock", "dyson", "electrolux",
    "exquisit", "gastroback", "gorenje", "grundig", "haier", "hisense", "hama", "instant", "jbl", "jura", "jvc", "kenwood",
    "kitchenaid", "krups", "lg", "loewe", "medion", "melitta", "miele", "ninja", "nokia", "panasonic", "peaq", "philips",
    "remington", "rommelsbacher", "rowenta", "sage", "samsung", "sharp", "siemens", "silva", "sony", "sonero", "tcl",
    "tefal", "telefunken", "thomson", "valera", "wmf", "xiaomi",
]
MODEL_MIN_LEN = 5
MODEL_BLOCKLIST = [
    "1080P", "120HZ", "144HZ", "240HZ", "360HZ", "4K", "5G", "500ML", "60HZ", "8K", "AIRFRYER", "ANDROID", "BLACK",
    "BLUETOOTH", "CHROMECAST", "DUAL", "ELECTRONIC4YOU", "EXPERT", "FULLHD", "GOOGLE", "HDR", "HDR10", "HDR10PLUS",
    "HDREADY", "HEPA", "INVERTER", "IQ300", "IQ500", "IQ700", "MEMC", "MINILED", "OLED", "ONLINE", "QLED", "SERIE4",
    "SERIE6", "SERIE7", "SERIE8", "SERIE9", "SERIES4", "SERIES5", "SERIES6", "SERIES7", "SERIES8", "SERIES9", "SILBER",
    "SILVER", "SMARTTV", "TRIPLE", "UHD", "WASHTOWER", "WEISS", "WHITE", "WIFI", "WLAN",
]
# Patterns of words that look like models and aren't.
GENERIC_MODELS = [r"^(?:IQ|SERIE|SERIES)\d{2,4}$", r"^\d{2,4}(?:SERIE|SERIES)$", r"^(?:A|X|Q)PRO$", r"^SMART(?:TV)?$", r"^FULLHD$", r"^HDR\d*PLUS?$"]
MODEL_JOIN_STOPWORDS = [
    "A", "AND", "CM", "C7", "DB", "DISPLAYPORT", "FULL", "G", "GOOGLE", "GRAMM", "HD", "HZ", "INCH", "KG", "L", "LED",
    "LITER", "M", "MIN", "ML", "MM", "EURO", "HDMI", "IEC", "LIGHTNING", "PRO", "RJ45", "SMART", "TV", "U", "UHD", "USB",
    "V", "W", "WATT", "ZOLL",
]

# Product kinds by what the normalised text contains; the first that matches counts.
KIND_PATTERNS = {
    "air_fryer": ["airfryer", "heissluftfritteuse", "heißluftfritteuse", "fritteuse"],
    "coffee_machine": ["espresso", "kaffeemaschine", "kaffeevollautomat", "siebtraeger", "siebträger"],
    "descaler": ["descaler", "entkalker"],
    "dishwasher": ["geschirrspuler", "geschirrspüler", "dishwasher"],
    "dryer": ["trockner", "dryer"],
    "freezer": ["gefrierschrank", "freezer"],
    "fridge": ["kuhlschrank", "kühlschrank", "refrigerator"],
    "grill": ["kontaktgrill", "grill", "optigrill"],
    "hair_styler": ["haarglatter", "haarglätter", "hair straightener", "lockenstab", "hair dryer", "haartrockner"],
    "headphone": ["kopfhorer", "kopfhörer", "headset", "earbuds", "ohrhorer", "ohrhörer"],
    "hob": ["kochfeld", "glaskeramikkochfeld", "ceranfeld"],
    "kettle": ["wasserkocher", "kettle"],
    "microwave": ["mikrowelle", "microwave"],
    "mixer": ["mixer", "standmixer", "handmixer", "blender", "zerkleinerer", "kuchenmaschine", "küchenmaschine"],
    "range_hood": ["wandhaube", "dunstabzug", "abzugshaube"],
    "toaster": ["toaster"],
    "tv": ["fernseher", "smart tv", "google tv", "oled", "qled", "led tv"],
    "vacuum": ["staubsauger", "vacuum", "wischsauger"],
    "washer": ["waschmaschine", "toplader", "frontlader", "washing machine"],
    "washer_dryer": ["waschtrockner", "washer dryer"],
}

# Words of questions.
QUERY_STOPWORDS = [
    "a", "about", "all", "and", "any", "bitte", "can", "compare", "der", "die", "ein", "eine", "find", "for", "from", "fur",
    "für", "get", "gib", "give", "ich", "in", "is", "kannst", "me", "match", "matching", "mir", "mit", "of", "on", "please",
    "show", "to", "und", "what", "with",
]
FILTER_TOKENS = [
    "alles", "allesamt", "below", "between", "billig", "cheapest", "competitor", "competitors", "filter", "hidden",
    "higher", "less", "lower", "max", "maximum", "min", "minimum", "more", "most", "only", "over", "price", "retailer",
    "than", "under", "visible", "amazon", "cyberport", "electronic", "electronic4you", "etec", "expert", "e tec",
    "mediamarkt", "media", "markt",
]
NON_ANCHOR_TOKENS = [
    "again", "are", "bad", "better", "different", "any", "detail", "details", "dont", "else", "for", "from", "good",
    "have", "has", "item", "items", "list", "like", "me", "more", "next", "no", "not", "only", "ones", "other", "others",
    "product", "products", "regarding", "related", "result", "results", "search", "show", "similar", "that", "there",
    "the", "these", "those", "which", "with",
]
EXPAND_PHRASES = [
    "any more", "anything else", "different ones", "dont like", "don't like", "else", "more results", "next ones",
    "no more", "other ones", "others",
]
EXPAND_TOKENS = ["again", "another", "different", "else", "extra", "more", "next", "remaining"]
RETAILER_KEYWORDS = {
    "expert at": "Expert AT",
    "expert": "Expert AT",
    "cyberport": "Cyberport AT",
    "electronic4you": "electronic4you.at",
    "electronic 4 you": "electronic4you.at",
    "e tec": "E-Tec",
    "etec": "E-Tec",
    "amazon": "Amazon AT",
    "mediamarkt": "MediaMarkt AT",
    "media markt": "MediaMarkt AT",
}
CATEGORY_KEYWORDS = {
    "TV & Audio": ["tv", "audio", "fernseher", "qled", "oled", "soundbar", "headphone", "kopfh", "lautsprecher"],
    "Small Appliances": ["small", "appliance", "airfryer", "heissluft", "toaster", "coffee", "espresso", "kettle", "haargl", "mixer", "vacuum", "staubsauger"],
    "Large Appliances": ["large", "washing", "washer", "dishwasher", "geschirr", "kuehlschrank", "kühlschrank", "kuhlschrank", "gefrier", "dryer", "toplader", "frontlader"],
}
KIND_KEYWORDS = {
    "air_fryer": ["airfryer", "air fryers", "air fryer", "heissluftfritteuse", "heissluftfritteusen"],
    "coffee_machine": ["espresso", "espressomaschine", "kaffeemaschine", "coffee machine", "coffee machines"],
    "dishwasher": ["dishwasher", "dishwashers", "geschirrspuler", "geschirrspulers"],
    "dryer": ["dryer", "dryers", "trockner", "trocknern"],
    "freezer": ["freezer", "freezers", "gefrierschrank", "gefrierschraenke"],
    "fridge": ["fridge", "fridges", "kuehlschrank", "kuehlschranke"],
    "headphone": ["headphone", "headphones", "headset", "headsets", "kopfhorer", "kopfhorern"],
    "hob": ["kochfeld", "kochfelder", "hob", "hobs", "cooktop", "cooktops"],
    "kettle": ["kettle", "kettles", "wasserkocher", "wasserkochern"],
    "microwave": ["microwave", "microwaves", "mikrowelle", "mikrowellen"],
    "mixer": ["mixer", "mixers", "blender", "blenders", "kuechenmaschine", "kuchenmaschine"],
    "toaster": ["toaster", "toasters"],
    "tv": ["tv", "tvs", "television", "televisions", "fernseher", "fernsehern", "qled", "oled"],
    "vacuum": ["vacuum", "vacuums", "staubsauger", "staubsaugern"],
    "washer": ["washer", "washers", "washing machine", "washing machines", "waschmaschine", "waschmaschinen"],
    "washer_dryer": ["washer dryer", "washer dryers", "waschtrockner", "waschtrocknern"],
}

# First words of names that count as a brand when products are enriched for retrieval.
ENRICHMENT_BRANDS = [
    "samsung", "lg", "sony", "philips", "sharp", "tcl", "hisense", "xiaomi", "grundig", "telefunken", "panasonic", "toshiba",
    "jvc", "metz", "loewe", "nokia", "peaq", "chiq", "dyon", "ok", "ok.", "thomson", "strong", "jbl", "bose", "sonos",
    "harman", "sennheiser", "jabra", "apple", "remington", "braun", "rowenta", "dyson", "bosch", "siemens", "delonghi",
    "nespresso", "krups", "melitta", "jura", "saeco", "tefal", "wmf", "sage", "ninja", "cosori", "instant", "miele", "aeg",
    "electrolux", "gorenje", "haier", "arçelik", "hama", "goobay", "deleycon", "ancable", "sonero", "mcbazel",
]
