"""Results depend on these exact texts, so they are stated plainly and kept together."""

# Common English words. A text word counts as English when it contains any of them.
ENGLISH_WORDS = """
the and is in to of a for with on at by
this that from they we be have an as are was
but not or had will would there been their were
which all if more when who what so no out up
he she it my your his her its our us them
those these about now time can said each get has
him old see two way may come could work first
after back other many than then new some take day
""".split()

# Common Arabic words. A text word counts as Arabic when it equals one of them.
ARABIC_WORDS = """
في من إلى على عن مع كل هذا هذه ذلك تلك
التي الذي لكن أو أم إذا عند بعد قبل
حول ضد تحت فوق أمام خلف جانب داخل خارج بين
أثناء خلال عبر حتى منذ لدى لديه لديها معه معها
له لها لهم لهن منه منها منهم منهن إليه إليها
عليه عليها عنه عنها فيه فيها به بها كما إن
أن كان كانت يكون تكون سوف قد لقد قام قامت
يقول تقول قال قالت أقول نقول أعلن أعلنت يعلن
الآن اليوم أمس غدا هنا هناك هنالك حيث أين متى
كيف ماذا لماذا من أي كم عاجل أخبار جديد مهم
الجامعة بارزاني السليمانية نموذج التعليم الحر بالعراق
الأميركية رسخت نيجيرفان العراق العربية الدولة الحكومة
الرئيس الوزير المجلس البرلمان الشعب المواطن البلد
المدينة القرية الشارع البيت المكتب المدرسة المستشفى
الشركة المصنع السوق المتجر المطعم الفندق المطار
الطريق الجسر النهر البحر الجبل الصحراء الغابة
""".split()

# Keyword lists used for a country without a filtering section: (English, Arabic) pairs.
DEFAULT_KEYWORDS = {
    "significant": [
        ("breaking news", "أخبار عاجلة"),
        ("alert", "تنبيه"),
        ("urgent", "عاجل"),
        ("emergency", "طارئ"),
        ("crisis", "أزمة"),
    ],
    "trivial": [
        ("weather", "طقس"),
        ("sports", "رياضة"),
        ("entertainment", "ترفيه"),
        ("celebrity", "مشاهير"),
    ],
    "exclude": [
        ("advertisement", "إعلان"),
        ("promo", "ترويج"),
        ("discount", "خصم"),
        ("sale", "تخفيضات"),
    ],
}

# Canonical record, in column order.
MESSAGE_FIELDS = [
    "Message_ID", "Channel", "Message_URL", "Country", "Date", "Time", "Author", "Message_Text",
    "Attached_Links", "AI_Category", "AI_Reasoning", "Keywords_Matched", "Message_Type",
    "Forward_From", "Media_Type", "Original_Text", "Original_Language", "Was_Translated",
    "Processed_Date",
]

# Columns left out of alerts and of the sheet feed.
EXCLUDED_FIELDS = [
    "Country", "AI_Category", "Message_Type", "Forward_From", "Media_Type", "Was_Translated",
    "Processed_Date", "Author",
]

# Classification methods.
METHOD_EXCLUDED = "excluded"
METHOD_SIGNIFICANT = "the list of SIGNIFICANT keywords"
METHOD_TRIVIAL = "the list of TRIVIAL keywords"
METHOD_NONE = "no matching keywords across all keyword lists"
METHOD_ERROR = "error"

# Link patterns. The character range $-_ covers digits, capitals and most URL punctuation.
URL_PATTERN = r"https?://[!$-_a-z]+"
DOMAIN_PATTERN = (
    r"(?:www\.)?[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?"
    r"(?:\.[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?)*\.[a-zA-Z]{2,}"
)
PRIVATE_LINK_TERMS = ["download", "file_id", "access_token"]

# Alert lookups.
COUNTRY_FLAGS = {"Philippines": "🇵🇭", "Indonesia": "🇮🇩", "Iraq": "🇮🇶", "Unknown": "🌏", "unknown": "🌏"}
DEFAULT_FLAG = "🌏"
SEVERITY_COLORS = {"good": "28a745", "warning": "ffc107", "attention": "dc3545", "info": "17a2b8"}
DEFAULT_COLOR = "17a2b8"
IMPACT_EMOJI = {"LOW": "🟡", "MEDIUM": "🟠", "HIGH": "🔴", "CRITICAL": "🚨"}
DEFAULT_IMPACT = "🔴"
SYSTEM_EMOJI = {"ERROR": "❌", "WARNING": "⚠️", "INFO": "ℹ️", "SUCCESS": "✅"}
DEFAULT_SYSTEM = "🔔"
SYSTEM_COLORS = {"ERROR": "attention", "WARNING": "warning", "INFO": "good", "SUCCESS": "good"}

# Error counts after which one notification is sent, per source.
NOTIFY_EVERY = {
    "language_detection": 50, "translation": 20, "model": 10, "fetch": 10,
    "logging": 10, "files": 5, "sheet": 3,
}

# Resource warning levels in percent.
RESOURCE_THRESHOLDS = {"memory": 80.0, "swap": 50.0, "disk": 80.0}

# Date of an archive row, and the two stamps a log line can start with.
CSV_DATE = r"\A20[0-9]{2}-[0-1][0-9]-[0-3][0-9]\z"
SHORT_STAMP = r"\A\[20[0-9]{6}_[0-9]{2}:[0-9]{2}:[0-9]{2}\]:"
LONG_STAMP = r"\A\[20[0-9]{2}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2},[0-9]{3}: [A-Z]+/[^\]]+\]"

# Texts by which log lines tell what happened.
MARKERS = {
    "success": "SharePoint response: status=200",
    "crash_alert": "SharePointInitializationError",
    "admin_message": "admin message to Teams",
    "task": "save_to_sharepoint",
}
