"""Constants, settings and table schemas of the event engine."""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values: they are part of the results ------------------------------------------------------

TIME_ZONE = "Asia/Singapore"  # UTC+8, no daylight saving time
OFFSET_HOURS = 8

LAT_MIN, LAT_MAX = 1.15, 1.48
LNG_MIN, LNG_MAX = 103.59, 104.10

REGIONS: dict[str, tuple[str, ...]] = {
    "CENTRAL": (
        "BISHAN", "BUKIT MERAH", "BUKIT TIMAH", "DOWNTOWN CORE", "GEYLANG", "KALLANG",
        "MARINA EAST", "MARINA SOUTH", "MARINE PARADE", "MUSEUM", "NEWTON", "NOVENA",
        "ORCHARD", "OUTRAM", "QUEENSTOWN", "RIVER VALLEY", "ROCHOR", "SINGAPORE RIVER",
        "SOUTHERN ISLANDS", "STRAITS VIEW", "TANGLIN", "TOA PAYOH",
    ),
    "EAST": ("BEDOK", "CHANGI", "CHANGI BAY", "PASIR RIS", "PAYA LEBAR", "TAMPINES"),
    "NORTH": (
        "CENTRAL WATER CATCHMENT", "LIM CHU KANG", "MANDAI", "SEMBAWANG", "SIMPANG",
        "SUNGEI KADUT", "WOODLANDS", "YISHUN",
    ),
    "NORTH-EAST": (
        "ANG MO KIO", "HOUGANG", "NORTH-EASTERN ISLANDS", "PUNGGOL", "SELETAR", "SENGKANG",
        "SERANGOON",
    ),
    "WEST": (
        "BOON LAY", "BUKIT BATOK", "BUKIT PANJANG", "CHOA CHU KANG", "CLEMENTI", "JURONG EAST",
        "JURONG WEST", "PIONEER", "TENGAH", "TUAS", "WESTERN ISLANDS", "WESTERN WATER CATCHMENT",
    ),
}
AREA_REGION = {area: region for region, areas in REGIONS.items() for area in areas}

#: Areas whose names are ordinary words elsewhere; they prove nothing on their own.
AMBIGUOUS_AREAS = (
    "MUSEUM", "ORCHARD", "NEWTON", "PIONEER", "RIVER VALLEY", "DOWNTOWN CORE", "STRAITS VIEW",
    "SOUTHERN ISLANDS", "WESTERN ISLANDS", "NORTH-EASTERN ISLANDS", "CENTRAL WATER CATCHMENT",
    "WESTERN WATER CATCHMENT", "MARINA EAST", "MARINA SOUTH", "SINGAPORE RIVER", "OUTRAM", "SIMPANG",
    "TENGAH", "CHANGI BAY", "MANDAI", "TANGLIN", "NOVENA", "ROCHOR", "KALLANG",
)

#: id, label, what it includes.
CATEGORIES = (
    ("career_fair", "Career fairs & job fairs", "job fairs, recruitment drives, career expos, hiring days"),
    ("career_dev", "Career development", "resume clinics, career talks, mentoring, industry sharing"),
    ("networking", "Networking", "mixers, meetups for professionals, founder nights"),
    ("tech_startup", "Tech & startups", "hackathons, demo days, dev meetups, AI talks"),
    ("community", "Community events", "CC events, block parties, neighbourhood carnivals, festive gatherings"),
    ("volunteering", "Volunteering", "volunteer drives, donation drives, befriending, clean-ups"),
    ("workshop_class", "Workshops & classes", "courses, hands-on classes, skill workshops"),
    ("talks", "Talks & seminars", "public lectures, panels, book talks"),
    ("arts_culture", "Arts & culture", "exhibitions, theatre, heritage walks, cultural festivals"),
    ("music", "Music & performances", "concerts, gigs, free performances"),
    ("family_kids", "Family & kids", "children's programmes, school-holiday activities"),
    ("sports_fitness", "Sports & fitness", "runs, group workouts, tournaments"),
    ("nature_outdoors", "Nature & outdoors", "guided walks, gardening, park events"),
    ("food_markets", "Food & markets", "bazaars, flea markets, food festivals"),
    ("health_wellness", "Health & wellness", "health screenings, mental wellness, mindfulness"),
    ("faith_festivals", "Religious & festive", "festival celebrations, open houses, religious community programmes"),
    ("education_open_house", "Open houses & education fairs", "uni/poly open houses, education fairs"),
    ("youth", "Youth", "youth programmes, youth centres, student-led events"),
    ("seniors", "Seniors", "active ageing programmes, senior-friendly classes"),
)
CATEGORY_IDS = tuple(c[0] for c in CATEGORIES)
LABELS = {c[0]: c[1] for c in CATEGORIES}
MOST_CATEGORIES = 3

SOURCE_TAGS = {
    "B71 Singapore": "tech_startup",
    "TEDxSingapore": "talks",
    "European Defense Tech Hub": "tech_startup",
    "Monad Foundation Events": "tech_startup",
    "GMI Cloud": "tech_startup",
    "Utila": "tech_startup",
    "0G's Event Calendar": "tech_startup",
    "NEAR Events": "tech_startup",
    "Mantle Events Calendar": "tech_startup",
    "Solana Summit": "tech_startup",
}

#: Title patterns (case-insensitive) whose categories are always kept.
TITLE_PATTERNS = (
    (r"\b(?:career|job|jobs|recruitment|hiring)\s+(?:fair|fest|expo|drive)s?\b|\bjob\s*fair\b|\bwalk-in interviews?\b", "career_fair"),
    (r"\bresume\b|\bcv clinic\b|\bmock interviews?\b|\bcareer (?:talk|coaching|clinic|mentoring)\b", "career_dev"),
    (r"\bnetworking\b|\bmixer\b", "networking"),
    (r"\bhackathon\b|\bdemo day\b|\bhacker house\b", "tech_startup"),
    (r"\bvolunteer(?:s|ing)?\b|\bdonation drive\b|\bbeach clean[- ]?up\b|\bblood drive\b", "volunteering"),
    (r"\bworkshop\b|\bmasterclass\b", "workshop_class"),
    (r"\bpanel\b|\bpublic lecture\b|\bbook talk\b|\bseminar\b|\bfireside chat\b|\bartist talk\b", "talks"),
    (r"\bexhibition\b|\bheritage walk\b", "arts_culture"),
    (r"\bconcert\b|\brecital\b|\blive music\b", "music"),
    (r"\bfun run\b|\bmarathon\b|\brun club\b|\b\d+\s?km (?:run|walk)\b", "sports_fitness"),
    (r"\bbazaar\b|\bflea market\b|\bfood festival\b|\bpasar malam\b|\bnight market\b", "food_markets"),
    (r"\bhealth screening\b|\bmindfulness\b|\bmental (?:health|wellness)\b", "health_wellness"),
    (
        r"\bopen house\b.*\b(?:poly(?:technic)?|university|school|college|campus|institute)\b"
        r"|\b(?:poly(?:technic)?|university|school|college|campus|institute)\b.*\bopen house\b"
        r"|\beducation fair\b",
        "education_open_house",
    ),
    (r"\bactive ageing\b|\bseniors?\b", "seniors"),
)

#: Words of questions (case-insensitive) that suggest a category.
QUESTION_PATTERNS = (
    (r"\b(?:career|job|jobs|recruitment|hiring)\s+(?:fairs?|expos?|fests?|drives?|days?)\b", "career_fair"),
    (r"\b(?:career (?:talks?|advice|coaching)|resume|cv|mentoring|mock interviews?)\b", "career_dev"),
    (r"\b(?:networking|mixers?|meet ?ups?)\b", "networking"),
    (r"\b(?:tech|startups?|hackathons?|ai|crypto|web3|developers?|coding)\b", "tech_startup"),
    (r"\b(?:community|neighbourhood|neighborhood|cc events?|block party)\b", "community"),
    (r"\b(?:volunteer\w*|donation drives?|clean[- ]?ups?)\b", "volunteering"),
    (r"\b(?:workshops?|classes|class|courses?|masterclass)\b", "workshop_class"),
    (r"\b(?:talks?|seminars?|lectures?|panels?|book talks?)\b", "talks"),
    (r"\b(?:art|arts|exhibitions?|museums?|theatre|theater|heritage)\b", "arts_culture"),
    (r"\b(?:music|concerts?|gigs?|live band|performances?)\b", "music"),
    (r"\b(?:kids?|children|family|families|toddlers?)\b", "family_kids"),
    (r"\b(?:runs?|running|fitness|sports?|yoga|workouts?|football|badminton)\b", "sports_fitness"),
    (r"\b(?:nature|parks?|gardens?|gardening|hikes?|hiking|outdoors?)\b", "nature_outdoors"),
    (r"\b(?:food|markets?|bazaars?|flea)\b", "food_markets"),
    (r"\b(?:wellness|health|mindfulness|meditation|mental health)\b", "health_wellness"),
    (r"\b(?:religious|temple|church|mosque|deepavali|hari raya|vesak|christmas)\b", "faith_festivals"),
    (r"\b(?:open houses?|education fairs?)\b", "education_open_house"),
    (r"\b(?:youth|teens?|teenagers?|students?)\b", "youth"),
    (r"\b(?:seniors?|elderly|active ageing)\b", "seniors"),
)

#: Phrases of dates in questions, in the order in which they are tried, and the window each stands for.
QUESTION_DATES = (
    (r"\btonight\b", "tonight"),
    (r"\btoday\b", "today"),
    (r"\btomorrow\b", "tomorrow"),
    (r"\b(?:this|on|coming)?\s*mondays?\b", "monday"),
    (r"\b(?:this|on|coming)?\s*tuesdays?\b", "tuesday"),
    (r"\b(?:this|on|coming)?\s*wednesdays?\b", "wednesday"),
    (r"\b(?:this|on|coming)?\s*thursdays?\b", "thursday"),
    (r"\b(?:this|on|coming)?\s*fridays?\b", "friday"),
    (r"\b(?:this|on|coming)?\s*saturdays?\b", "saturday"),
    (r"\b(?:this|on|coming)?\s*sundays?\b", "sunday"),
    (r"\b(?:this|the|over the|on)?\s*weekends?\b", "weekend"),
    (r"\bnext week\b", "next_week"),
    (r"\b(?:this week|next 7 days|the next week)\b", "week"),
    (r"\b(?:this month|next 30 days|coming month)\b", "month"),
)

#: Other phrases of questions; the place of QUESTION_SPOT is written with capitals, the rest in either case.
QUESTION_AREA_WORDS = r"\b(in|near|around|at)\s+"
QUESTION_SPOT = r"\b(?:near|around|close to|next to|at)\s+((?:[A-Z][\w'&-]*|MRT|CC|Mall)(?:\s+(?:[A-Z][\w'&-]*|MRT|CC|Mall|Station))*)"
QUESTION_POSTAL = r"\b(?:near|around|at)?\s*(?:singapore\s*)?(\d{6})\b"
QUESTION_REGION = r"\b(?:in|around)\s+(?:the\s+)?(north[- ]?east|north|east|west|central)(?:ern)?\b(?!\s+coast)"
QUESTION_NEAR_ME = r"\b(?:near me|nearby|near here|around me|close to me|close by)\b"
QUESTION_RADIUS = r"\bwithin\s+(\d+(?:\.\d+)?)\s*(?:km|kilometres?|kilometers?)\b"
QUESTION_FREE = r"\bfree(?: of charge)?\b(?! time)"
QUESTION_ONLINE = r"\b(?:online|virtual|webinars?|zoom)\b"
QUESTION_YOUNG = r"\byouth|teen"

#: Texts of answers.
NO_MATCHES = "I couldn't find any events that match. Try a wider radius, a longer date range or fewer categories."
REFUSED = "Sorry, I can't help with that. Try asking about events, places or dates in Singapore."
CLOSEST = "Here are the closest matches I found:"
OTHERS_BEFORE = "I couldn't find close matches for “"
OTHERS_AFTER = "”. Other events that fit your dates and place:"

#: Where a written range of dates or times is split, and what tells its halves apart.
RANGE_SPLIT = r"\s*(?:–|—|\s-\s|(?<=\d)-(?=\d)|(?<=[ap]m)-|\bto\b|\buntil\b|\btill\b)\s*"
TEXT_HAS_YEAR = r"\b(?:19|20)\d{2}\b"
NIGHT_BEFORE_HOUR = 6  # events of web pages that seem to begin or end before are likely to be labelled wrong

#: Words of a question that carry no meaning for search.
FILLER_WORDS = (
    "any anything are there what whats what's show me find events event happening some good please i "
    "want looking look for to go can the a an in at on near with and or is this next that which where when "
    "how do does get around of me my our we us you something things stuff about"
)

SOURCE_TIERS = {"manual": 1, "luma": 2, "eventbrite": 2, "web": 3}
DEFAULT_TIER = 3

NEWS_DOMAINS = (
    "straitstimes.com", "channelnewsasia.com", "todayonline.com", "mothership.sg", "zaobao.com.sg",
    "businesstimes.com.sg", "asiaone.com", "beritaharian.sg", "tamilmurasu.com.sg", "8world.com",
)
BLOCKED_DOMAINS = {
    "facebook.com": "prohibits automated access",
    "fb.com": "prohibits automated access",
    "instagram.com": "prohibits automated access",
    "linkedin.com": "prohibits automated access",
    "x.com": "prohibits automated access",
    "twitter.com": "prohibits automated access",
    "tiktok.com": "prohibits automated access",
    "threads.net": "prohibits automated access",
    "youtube.com": "video, not event listings",
    "reddit.com": "prohibits automated access",
    "t.me": "chat, not event listings",
    "telegram.me": "chat, not event listings",
    "whatsapp.com": "chat, not event listings",
    "quora.com": "prohibits automated access",
    "meetup.com": "API-only under its terms (needs Meetup Pro)",
    "onepa.gov.sg": "terms of use forbid storing or republishing its content without PA's written permission",
    "luma.com": "covered by the Luma ICS adapter; Luma's terms allow only its public feeds",
    "lu.ma": "covered by the Luma ICS adapter; Luma's terms allow only its public feeds",
    "google.com": "search engine",
    "bing.com": "search engine",
}

#: Audiences that texts restrict an event to, in order of precedence (case-insensitive).
AUDIENCE_PATTERNS = (
    (
        "students_only",
        r"\bstudents?[- ]only\b|\bonly (?:for|open to) (?:\w+\s+){0,3}students\b"
        r"|\bexclusive(?:ly)? (?:to|for) (?:\w+\s+){0,3}students\b",
    ),
    (
        "members_only",
        r"\bmembers?[- ]only\b|\bonly (?:for|open to) (?:\w+\s+){0,2}members\b"
        r"|\bexclusive(?:ly)? (?:to|for) (?:\w+\s+){0,2}members\b",
    ),
    (
        "alumni",
        r"\balumni[- ]only\b|\bonly (?:for|open to) (?:\w+\s+){0,2}alumni\b"
        r"|\bexclusive(?:ly)? (?:to|for) (?:\w+\s+){0,2}alumni\b",
    ),
)
ONLINE_PLACE = r"\b(online|virtual|webinar|zoom|microsoft teams|ms teams|google meet|livestream|live stream)\b"
ONLINE_TITLE = (
    r"\bwebinar\b|\blivestream\b|[(\[](?:online|virtual|zoom)[)\]]"
    r"|\b(?:online|virtual) (?:event|session|talk|workshop|meetup|webinar)\b"
)
ONLINE_LINK = r"zoom\.us/|teams\.microsoft\.com/|meet\.google\.com/|webex\.com/"
CANCELLED_TITLE = r"^\W*(cancel+ed|postponed)\b"
CANCELLED_TEXT = r"\b(?:event|session|programme|program) (?:is|has been) (?:cancel+ed|postponed)\b"
PRICE_PREFIXED = r"(?:S\$|SGD\s?|\$)\s?(\d{1,5}(?:,\d{3})*(?:\.\d{1,2})?)"
PRICE_SUFFIXED = r"\b(\d{1,5}(?:\.\d{1,2})?)\s?(?:SGD|dollars)\b"
TITLE_STOPWORDS = ("singapore", "sg", "event", "events")

#: Short forms of places that are spelt out before names are compared, and words that say nothing there.
PLACE_SHORT_FORMS = {
    "cc": "community club",
    "rc": "residents committee",
    "poly": "polytechnic",
    "blk": "block",
    "st": "street",
    "ave": "avenue",
    "rd": "road",
    "dr": "drive",
}
PLACE_STOPWORDS = ("singapore", "s")

#: Descriptions of calendar feeds: a line with a link before, an address block, a host's name after.
FEED_LINK = r"(?i)^(?:Get up-to-date information at|Find more information on):?\s*(\S+)\s*"
FEED_HIDDEN_ADDRESS = "check event page for more details"
FEED_HOST = r"\s*Hosted by [^\n]*\z"
FEED_EVENT_URL = "https://luma.com/event/"
MENTIONS_COUNTRY = r"\bsingapore\b|\bs'pore\b"

#: Radius steps of the search screen in km, and how its windows are worded.
RADIUS_STEPS = (1, 3, 5, 10)
WINDOW_PHRASES = {"today": "today", "weekend": "this weekend", "week": "in the next 7 days", "month": "in the next 30 days"}
DRAFT_NOTE = "No structured event data on this page: fill in the date and place yourself."
DRAFT_SELECTION_NOTE = " Your highlighted text is in the description."
ASK_FOR_PLACE = "share your location (or name a place) to search near you"


#: English stop words of text search.
STOP_WORDS = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it
    its itself they them their theirs themselves what which who whom this that these those am is are was were be been
    being have has had having do does did doing a an the and but if or because as until while of at by for with about
    against between into through during before after above below to from up down in out on off over under again
    further then once here there when where why how all any both each few more most other some such no nor not only
    own same so than too very s t can will just don should now""".split()
)

#: The English stemmer (Porter2): words with stems of their own, words left as they are once plurals are cut, and for
#: each later step its endings, what replaces them, the region they must lie in (1 or 2) and letters that must precede.
STEM_EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl",
    "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe",
    "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
STEM_LEFT = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
STEM_STEPS = (
    {
        "tional": ("tion", 1, ""), "enci": ("ence", 1, ""), "anci": ("ance", 1, ""), "abli": ("able", 1, ""),
        "entli": ("ent", 1, ""), "izer": ("ize", 1, ""), "ization": ("ize", 1, ""), "ational": ("ate", 1, ""),
        "ation": ("ate", 1, ""), "ator": ("ate", 1, ""), "alism": ("al", 1, ""), "aliti": ("al", 1, ""),
        "alli": ("al", 1, ""), "fulness": ("ful", 1, ""), "ousli": ("ous", 1, ""), "ousness": ("ous", 1, ""),
        "iveness": ("ive", 1, ""), "iviti": ("ive", 1, ""), "biliti": ("ble", 1, ""), "bli": ("ble", 1, ""),
        "ogi": ("og", 1, "l"), "fulli": ("ful", 1, ""), "lessli": ("less", 1, ""), "li": ("", 1, "cdeghkmnrt"),
    },
    {
        "tional": ("tion", 1, ""), "ational": ("ate", 1, ""), "alize": ("al", 1, ""), "icate": ("ic", 1, ""),
        "iciti": ("ic", 1, ""), "ical": ("ic", 1, ""), "ful": ("", 1, ""), "ness": ("", 1, ""), "ative": ("", 2, ""),
    },
    {
        "al": ("", 2, ""), "ance": ("", 2, ""), "ence": ("", 2, ""), "er": ("", 2, ""), "ic": ("", 2, ""),
        "able": ("", 2, ""), "ible": ("", 2, ""), "ant": ("", 2, ""), "ement": ("", 2, ""), "ment": ("", 2, ""),
        "ent": ("", 2, ""), "ism": ("", 2, ""), "ate": ("", 2, ""), "iti": ("", 2, ""), "ous": ("", 2, ""),
        "ive": ("", 2, ""), "ize": ("", 2, ""), "ion": ("", 2, "st"),
    },
)


@dataclass(frozen=True)
class Settings:
    """Thresholds; the values are those that give the known results."""

    merge_at: int = 85
    ask_at: int = 70
    same_place_m: float = 300.0
    candidates: int = 500
    per_list: int = 50
    fused: int = 30
    rrf_k: int = 60
    default_radius_m: float = 5000.0
    most_radius_km: float = 50.0
    boost: float = 0.15
    most_distance: float = 0.80
    distance_window: float = 0.15
    drop_threshold: float = 0.60
    least_history: int = 3
    least_median: float = 5.0
    error_rate: float = 0.10
    history_days: int = 7
    missed_crawls: int = 3
    horizon_days: int = 120
    batch_items: int = 128
    batch_tokens: int = 8000
    place_match: float = 80.0
    drafts_per_page: int = 10
    per_domain: int = 5
    most_pages: int = 40
    most_searches: int = 10
    most_events: int = 25
    most_seconds: int = 600


SETTINGS = Settings()
