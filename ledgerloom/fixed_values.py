"""Fixed values.

Everything in this file is data, not logic: word lists, patterns, dimension rows,
coefficients and messages whose exact content decides the results. They are kept
together, as plain text, in natural order.
"""

# --- identity -----------------------------------------------------------------

FINGERPRINT_VERSION = "v1"
DEFAULT_CURRENCY = "INR"
UNTITLED = "Unlabelled transaction"

# Currencies whose ISO 4217 exponent is not 2.
ZERO_DIGIT_CURRENCIES = [
    "BIF", "CLP", "DJF", "GNF", "ISK", "JPY", "KMF", "KRW", "PYG", "RWF",
    "UGX", "UYI", "VND", "VUV", "XAF", "XOF", "XPF",
]
THREE_DIGIT_CURRENCIES = ["BHD", "IQD", "JOD", "KWD", "LYD", "OMR", "TND"]

REFERENCE_LABEL_WORDS = [
    "UPI", "REF", "REFNO", "REFERENCE", "NO", "NUM", "NUMBER",
    "TXN", "TRANSACTION", "TRANS", "ID", "IDNO",
    "UTR", "RRN", "IMPS", "NEFT", "RTGS", "NPCI", "SEQ", "CHQ", "CHEQUE",
    "P2M", "P2A", "P2P",
]
REFERENCE_MIN_LENGTH = 6
REFERENCE_MIN_DIGITS = 4

MERCHANT_NOISE_WORDS = [
    "UPI", "IMPS", "NEFT", "RTGS", "POS", "ATM", "ECS", "ACH", "NACH",
    "PAYMENT", "PAYMENTS", "PAY", "PMT", "TXN", "TRANSACTION", "TRANSFER", "TRF",
    "REF", "REFNO", "RRN", "UTR", "NO", "ID",
    "DEBIT", "CREDIT", "DR", "CR", "PURCHASE", "MERCHANT", "ONLINE",
    "TO", "FROM", "VIA", "AT", "FOR", "THE", "AND",
    "PVT", "PVTLTD", "LTD", "LIMITED", "PRIVATE", "LLP", "INC", "CORP", "COMPANY",
    "COM", "CO", "IN", "INDIA", "TECHNOLOGIES", "TECHNOLOGY", "SERVICES", "SOLUTIONS",
    "BANK", "ACCOUNT", "AC", "ACCT",
]
MERCHANT_ACRONYM_MAX = 3
MERCHANT_IDENTIFIER_MIN = 8

# --- enumerations -------------------------------------------------------------

TRANSACTION_TYPES = ["DEBIT", "CREDIT"]
SOURCES = ["SMS", "CSV", "PDF", "MANUAL"]
PAYMENT_METHODS = [
    "UPI", "CARD", "ATM", "NET_BANKING", "IMPS", "NEFT", "RTGS", "AUTO_DEBIT",
    "WALLET", "CASH", "CHEQUE", "UNKNOWN",
]
PARSE_STATUSES = ["PARSED", "PARTIALLY_PARSED", "FAILED"]  # best first
CATEGORY_KINDS = ["EXPENSE", "INCOME", "TRANSFER"]
BATCH_STATUSES = ["SUCCESS", "PARTIAL", "FAILED"]
OUTCOMES = ["CREATED", "MERGED", "DUPLICATE_SKIPPED", "FAILED"]

# --- dimension rows -----------------------------------------------------------

# (id, name, kind, color_hex, icon_key, is_system_defined, sort_order)
DEFAULT_CATEGORIES = [
    (1, "Food", "EXPENSE", "FF7043", "food", True, 1),
    (2, "Shopping", "EXPENSE", "AB47BC", "shopping", True, 2),
    (3, "Transport", "EXPENSE", "42A5F5", "transport", True, 3),
    (4, "Bills", "EXPENSE", "26A69A", "bills", True, 4),
    (5, "Entertainment", "EXPENSE", "EC407A", "entertainment", True, 5),
    (6, "Travel", "EXPENSE", "29B6F6", "travel", True, 6),
    (7, "Healthcare", "EXPENSE", "EF5350", "healthcare", True, 7),
    (8, "Education", "EXPENSE", "5C6BC0", "education", True, 8),
    (9, "Rent", "EXPENSE", "8D6E63", "rent", True, 9),
    (10, "Salary", "INCOME", "66BB6A", "salary", True, 10),
    (11, "Investment", "TRANSFER", "9CCC65", "investment", True, 11),
    (12, "Transfer", "TRANSFER", "78909C", "transfer", True, 12),
    (13, "Cash Withdrawal", "TRANSFER", "BDBDBD", "cash", True, 13),
    (14, "Other", "EXPENSE", "90A4AE", "other", True, 14),
]

# (id, name, color_hex, is_system_defined, sort_order)
DEFAULT_LABELS_VERSION = 2
DEFAULT_LABELS = [
    (1, "Food", "FF7043", True, 1),
    (2, "Zomato", "E23744", True, 2),
    (3, "Swiggy", "FC8019", True, 3),
    (4, "Blinkit", "FFE141", True, 4),
    (5, "Zepto", "3C006A", True, 5),
    (6, "Chai / tea", "8D6E63", True, 6),
    (7, "Sweets", "EC407A", True, 7),
    (8, "Dining out", "FFA726", True, 8),
    (9, "Shopping", "AB47BC", True, 9),
    (10, "Amazon", "FF9900", True, 10),
    (11, "Flipkart", "2874F0", True, 11),
    (12, "DMart", "00838F", True, 12),
    (13, "Vishal Mega Mart", "5C6BC0", True, 13),
    (14, "Kirana / general store", "6D4C41", True, 14),
    (15, "Pharmacy", "EF5350", True, 15),
    (16, "Uber", "000000", True, 16),
    (17, "Ola", "C0F70A", True, 17),
    (18, "Petrol / fuel", "455A64", True, 18),
    (19, "Metro / bus", "1565C0", True, 19),
    (20, "Auto / rickshaw", "F9A825", True, 20),
    (21, "Rent / PG", "8D6E63", True, 21),
    (22, "Electricity", "FFCA28", True, 22),
    (23, "Mobile recharge", "29B6F6", True, 23),
    (24, "Broadband / Wi‑Fi", "7E57C2", True, 24),
    (25, "ATM cash", "78909C", True, 25),
    (26, "Family transfer", "66BB6A", True, 26),
    (27, "Friend split", "26A69A", True, 27),
    (28, "Salary", "43A047", True, 28),
    (29, "Unrecognised", "BDBDBD", True, 29),
    (30, "Needs review", "FFA726", True, 30),
]
CUSTOM_LABEL_COLOR = "90A4AE"
CUSTOM_LABEL_SORT = 1000

# --- alert messages (java.util.regex) -----------------------------------------

AMOUNT_HINT = (
    r"(?i)(?:Rs\.?|INR|₹|USD)\s*[\d,]+\.?\d*|[\d,]+\.?\d*\s*(?:USD|dollars?|INR|Rs\.?)|"
    r"\$\s*[\d,]+\.?\d*"
)
# (pattern, number of capture groups, currency), in this order
AMOUNT_PATTERNS = [
    (r"(?i)(?:Rs\.?|INR)\s*([\d,]+(?:\.\d{1,2})?)", 1, "INR"),
    (r"(?i)([\d,]+(?:\.\d{1,2})?)\s*(?:INR|Rs\.?)\b", 1, "INR"),
    (r"₹\s*([\d,]+(?:\.\d{1,2})?)", 1, "INR"),
    (r"(?i)USD\s*([\d,]+(?:\.\d{1,2})?)|([\d,]+(?:\.\d{1,2})?)\s*(?:USD|dollars?)", 2, "USD"),
    (r"\$\s*([\d,]+(?:\.\d{1,2})?)", 1, "USD"),
    (
        r"(?i)(?:debited|credited|spent|paid|received|payment\s+of)\s+(?:for\s+)?"
        r"([\d,]+(?:\.\d{1,2})?)",
        1,
        "INR",
    ),
]
DEBIT_HINT = r"(?i)\b(debited|withdrawn|withdrawal|paid\s+to|sent\s+to|purchase)\b"
CREDIT_HINT = (
    r"(?i)\b(credited|deposited|refund(?:ed)?|received\s+from|received\s+in\s+your)\b"
)
SPENT_HINT = r"(?i)\b(spent|purchase|using\s+your|used\s+(?:for|at)|txn\s+of|payment\s+of)\b"
MOVEMENT_NEAR_AMOUNT = (
    r"(?i)\b(debited|credited|spent|paid|purchase|using\s+your|used\s+(?:for|at)|"
    r"payment\s+of|withdrawn|deposited|refund(?:ed)?)\b"
)
UPI_HINT = r"(?i)\bUPI\b"
INFORMATIONAL_HINT = (
    r"(?i)(?:avail(?:able)?|avl|avbl|remaining|unused)\s+(?:credit\s+)?(?:limit|lim|bal(?:ance)?)|"
    r"(?:credit\s+)?limit\s+(?:is|of|available|remaining|has\s+been|increased|decreased|revised|enhanced|:)|"
    r"(?:avail(?:able)?|avl|avbl)\s+bal(?:ance)?|"
    r"outstanding|(?:total|min(?:imum)?|amt)\s+(?:amt\s+)?due|payment\s+due|due\s+(?:date|amt|amount)|"
    r"statement\s+(?:is\s+)?generated|reward\s+points?|"
    r"card\s+(?:is\s+)?(?:blocked|hotlisted|expired)|"
    r"overdue"
)
LIMIT_AMOUNT_PREFIX = (
    r"(?i)(?:avail(?:able)?|avl|avbl|remaining|unused).{0,24}(?:limit|lim|bal(?:ance)?).{0,28}$|"
    r"(?:credit\s+)?limit\s+(?:is|of|:)?\s*$|"
    r"outstanding(?:\s+(?:amt|amount|bal(?:ance)?))?\s*[:\-]?\s*$|"
    r"(?:total|min(?:imum)?|amt)\s+(?:amt\s+)?due\s*[:\-]?\s*$|"
    r"payment\s+due\s*[:\-]?\s*$|"
    r"reward\s+points?\s*[:\-]?\s*$"
)
LIMIT_AMOUNT_SUFFIX = (
    r"(?i)^\s*(?:is|as)?\s*(?:your\s+)?(?:avail(?:able)?|remaining|unused).{0,24}(?:limit|bal)|"
    r"^\s*(?:INR|Rs\.?|₹)?\s*(?:is\s+)?(?:your\s+)?(?:remaining|available)\s+(?:credit\s+)?limit"
)
LIMIT_PREFIX_WINDOW = 48
LIMIT_SUFFIX_WINDOW = 36
MOVEMENT_WINDOW_BEFORE = 40
MOVEMENT_WINDOW_AFTER = 24
ALERT_ACCOUNT = r"(?i)(?:a/?c|acct|account)(?:\s*no\.?)?[^\dX*]*([X*]{2,}\d{2,}|\d{4})"
UPI_PATH = r"(?i)\bUPI/[A-Za-z0-9]+/(\d{6,})/([^\n\r]+)"
REFERENCE_CAPTURE = (
    r"(?i)(?:UPI\s*(?:Ref(?:erence)?(?:\s*No\.?)?|Txn(?:n)?(?:\s*ID)?|ID)?|UTR|RRN|"
    r"Ref(?:erence)?(?:\s*No\.?)?|Txn(?:n)?(?:\s*ID)?)\s*[:\-]?\s*([A-Z0-9]{6,})"
)
WALLET_TXN_IN_TEXT = r"\bT\d{15,}\b"
BODY_DATE_TIME = (
    r"\b(\d{1,2}[-/]\d{1,2}[-/]\d{2,4}),?\s+(\d{1,2}:\d{2}(?::\d{2})?(?:\s*[AaPp][Mm])?)\b"
)
BANK_MOVEMENT_HINT = r"(?i)(?:debited\s+from|credited\s+to\s+your|withdrawn\s+from|not you\?)"
PROMOTIONAL_HINT = (
    r"(?i)(?:credited\s+(?:in|to)\s+your\s+wallet|wallet.{0,40}(?:till|until|valid|expir)|"
    r"(?:till|until|valid(?:\s+(?:till|until|upto|up to))?|expir(?:es|y|ing)?)\b.{0,40}wallet|"
    r"eager to serve|\b(?:voucher|coupon|promo(?:tion|tional)?|offer code|cashback)\b|"
    r"\bwill be credited\b|\b(?:win|unlock|grab|flat)\s+(?:rs\.?|inr|₹)|"
    r"up\s*to\s+(?:rs\.?|inr|₹)|pre-approved|limited\s+period\s+offer|"
    r"exclusive\s+offer|don'?t\s+miss|hurry\s+up)"
)
ALERT_MERCHANT_PATTERNS = [
    r"(?i)(?:to|at|towards)\s+VPA\s+([^\s,]+@[^\s,]+)",
    r"(?i)(?:to|at|towards)\s+([A-Za-z0-9][A-Za-z0-9 .&'\-]{1,40}?)(?:\s+on\s|\s+UPI|\s+Ref|\s+Info|\.|$)",
    r"(?i)(?:from)\s+([A-Za-z0-9][A-Za-z0-9 .&'\-]{1,40}?)(?:\s+on\s|\s+UPI|\s+Ref|\.|$)",
]
# First contained word wins.
ALERT_METHOD_WORDS = [
    ("UPI", ["UPI"]),
    ("IMPS", ["IMPS"]),
    ("NEFT", ["NEFT"]),
    ("RTGS", ["RTGS"]),
    ("ATM", ["ATM", "CASH WDL"]),
    ("CARD", ["CARD"]),
]
ALERT_DESCRIPTION_LENGTH = 240

# --- classifier: (feature, pattern on lower-case text, coefficient) -----------

NOT_A_PAYMENT_BIAS = 2.64560663
NOT_A_PAYMENT_THRESHOLD = 0.72
CLASSIFIER_FEATURES = [
    ("debited", r"\bdebited\b", -0.82863798),
    ("credited", r"\bcredited\b", -0.34656005),
    ("spent", r"\bspent\b", -1.89019771),
    ("purchase", r"\bpurchase\b", -1.17463234),
    ("using_your", r"\busing your\b", -1.87292889),
    ("payment_of", r"\bpayment of\b", -0.95821047),
    ("withdrawn", r"\bwithdrawn\b", -0.20493032),
    ("upi", r"\bupi\b", -1.62890399),
    (
        "ref_utr",
        r"\b(upi\s*ref|utr|rrn|ref(?:erence)?(?:\s*no)?|txn(?:n)?(?:\s*id)?)\b",
        -0.94627477,
    ),
    ("account_mask", r"(?:a/?c|acct|account).{0,12}(?:xx+|[x*]{2,})\d{2,}", -1.69058811),
    ("not_you", r"\bnot you\b", -0.76855881),
    (
        "available_limit",
        r"\b(?:available|avail|avl|avbl)\s+(?:credit\s+)?(?:limit|lim)\b",
        0.50651783,
    ),
    ("remaining_limit", r"\b(?:remaining|unused)\s+(?:credit\s+)?limit\b", 0.20120653),
    ("avl_bal", r"\b(?:available|avail|avl|avbl)\s+bal(?:ance)?\b", -0.60383318),
    ("outstanding", r"\boutstanding\b", 0.60135873),
    (
        "due",
        r"\b(?:total|min(?:imum)?|amt|payment)\s+due\b|\bdue\s+(?:date|amt|amount)\b",
        1.14212705,
    ),
    ("statement", r"\bstatement\b", 0.36396575),
    ("reward_points", r"\breward\s+points?\b", 0.33721412),
    ("wallet", r"\bwallet\b", 0.24911635),
    ("offer", r"\b(?:voucher|coupon|promo(?:tion|tional)?|offer)\b", 0.39536257),
    ("cashback", r"\bcashback\b", 0.13025262),
    ("will_be_credited", r"\bwill be credited\b", 0.18041898),
    ("pre_approved", r"\bpre-?approved\b", 0.39328365),
    ("otp", r"\botp\b", 0.29449252),
    ("credit_card", r"\bcredit card\b", -0.54407634),
    ("inr_rs", r"\b(?:inr|rs\.?|₹)\b", -0.42128289),
    ("two_amounts", r"(?:(?:rs\.?|inr|₹|usd)\s*[\d,]+\.?\d*)", -0.87287969),
    (
        "sender_bank",
        r"\b(?:ax-|vm-|vk-|ad-|jd-|bk-|hdfc|sbi|axis|icici|kotak|pnb|bob|yesbk|indus)\b",
        -0.72560543,
    ),
    ("upi_path", r"\bupi/[a-z0-9]+/\d+", -0.53938302),
    ("blockupi", r"\bblockupi\b", -0.04995963),
    ("expiry_offer", r"\b(?:till|until|valid|expir)", 0.45157937),
    (
        "limit_changed",
        r"\blimit\s+has been\b|\blimit\s+(?:increased|decreased|revised|enhanced)\b",
        0.47172637,
    ),
    ("overdue", r"\boverdue\b", 0.25851638),
    ("usd", r"\b(?:usd|dollars?)\b", -0.95821047),
    ("received_from", r"\breceived from\b", 0.00000000),
    ("emi", r"\bemi\b", 0.39328365),
    ("generated", r"\bgenerated\b", 0.48638382),
    ("unlock_win", r"\b(?:unlock|win|grab|hurry)\b", 0.46405993),
]

# --- statement cells ----------------------------------------------------------

CELL_DEBIT = r"(?i)^(DEBIT|DR|D|WITHDRAWAL|WITHDRAWN|DEBITED)$"
CELL_CREDIT = r"(?i)^(CREDIT|CR|C|DEPOSIT|DEPOSITED|CREDITED)$"
CELL_ACCOUNT_MASK = r"(?i)[X*]{2,}\d{3,}"
CELL_WALLET_TXN = r"^T\d{15,}$"
CELL_ALNUM_REFERENCE = r"(?i)^[A-Z]{2,}\d{6,}$"
CELL_HEADER = (
    r"(?i)^(date|time|amount|debit|credit|balance|narration|description|particulars|"
    r"transaction details|transaction id|transaction type|utr|reference|"
    r"credit/debit instrument|type|ref|ref no|withdrawal|deposit)$"
)
LONG_NUMBER_MIN = 8
WALLET_TXN_MIN = 16
NARRATIVE_PARTY = (
    r"(?i)^(?:Paid to|Received from|Refund from)\s+(.+?)"
    r"(?:\s+UPI\b|\s+Paid by\b|\s+Received by\b|$)"
)
NARRATIVE_UPI_PARTY = r"(?i)UPI[/\-]([^/\-\s]+)"
NARRATIVE_DEBIT = r"^paid to|debited|withdraw|spent"
NARRATIVE_CREDIT = r"^received from|^refund from|credited"

# --- statement CSV ------------------------------------------------------------

CSV_BOILERPLATE = (
    r"^this is an automatically|^disclaimer|phonepe terms|fictitious offers|"
    r"^transaction statement for|^duration"
)
CSV_WALLET_NAME = "PhonePe"
CSV_RAW_LENGTH = 500
CSV_STUB_RAW_LENGTH = 300
CSV_EMPTY_MESSAGE = "No date+amount rows found in CSV"

# --- statement text -----------------------------------------------------------

# Repairs for glued words, applied in this order.
TEXT_REPAIRS = [
    (r"(?i)UPITransactionID\s*:", "UPI Transaction ID:"),
    (r"(?i)UPI\s*Transaction\s*ID\s*:", "UPI Transaction ID:"),
    (r"(?i)(\d{1,2}:\d{2})([ap]m)\b", "$1 $2"),
    (r"(?i)Paidby", "Paid by "),
    (r"(?i)Receivedby", "Received by "),
    (r"(?i)Paidto", "Paid to "),
    (r"(?i)Receivedfrom", "Received from "),
    (r"(?i)Date&time", "Date & time"),
    (r"(?i)Transactiondetails", "Transaction details"),
    (r"(?i)Transactionstatement", "Transaction statement"),
    (r"UPI Transaction ID:\s*", "UPI Transaction ID: "),
]
TEXT_BOILERPLATE = (
    r"OPENING BALANCE|CLOSING BALANCE|^PAGE |^SR NO|^DATE & TIME|^NOTE:|GOOGLE PAY APP|"
    r"^SENT$|^RECEIVED$|^AMOUNT$|^TRANSACTION DETAILS$"
)
TEXT_DATE_IN_LINE = r"\d{1,2}\s+[A-Za-z]{3,9},?\s+\d{4}|\d{1,2}[/-]\d{1,2}[/-]\d{2,4}"
TEXT_PAYMENT_CUE = r"PAID TO|RECEIVED FROM|REFUND FROM|UPI"
TEXT_ROW_CUE = r"PAID TO|RECEIVED FROM|REFUND|UPI|IMPS|NEFT"
WALLET_DATE = r"\d{1,2}\s+[A-Za-z]{3,9},?\s+\d{4}"
# date, time, party, reference, amount
WALLET_STACKED = (
    r"(?is)(\d{1,2}\s+[A-Za-z]{3,9},?\s+\d{4})\s+(\d{1,2}:\d{2}\s*[AaPp][Mm])\s+"
    r"((?:Paid to|Received from|Refund from)\s+[^\n\r]+?)\s+"
    r"UPI\s+Transaction\s+ID:\s*(\d{6,})\s+"
    r"(?:Paid by[^\n\r₹]*)?\s*₹\s*([\d,]+\.?\d*)"
)
# date, party, amount, time, reference
WALLET_LAYOUT = (
    r"(?is)(\d{1,2}\s+[A-Za-z]{3,9},?\s+\d{4})\s+"
    r"((?:Paid to|Received from|Refund from)\s+.+?)\s+"
    r"₹\s*([\d,]+\.?\d*)\s+"
    r"(\d{1,2}:\d{2}\s*[AaPp][Mm])\s+"
    r"UPI\s+Transaction\s+ID:\s*(\d{6,})"
)
WALLET_PARTY = r"(?i)^(?:Paid to|Received from|Refund from)\s+(.+)$"
TEXT_RAW_LENGTH = 500
TEXT_NO_BLOCKS_MESSAGE = "No dated amount rows found in PDF"
TEXT_NO_ROWS_MESSAGE = "Could not assemble transactions from PDF text"

# --- import run messages ------------------------------------------------------

BATCH_FAILED_MESSAGE = "No new transactions could be imported."
BATCH_PARTIAL_MESSAGE = "Imported with %d row(s) that could not be fully understood."
FILE_UNSUPPORTED_MESSAGE = "Unsupported file type. Choose a CSV or PDF statement."
CSV_UNRECOGNISED_MESSAGE = (
    "Could not recognise the CSV columns. Expected a date column and debit/credit or amount."
)
TEXT_BLANK_MESSAGE = (
    "No text found in the PDF. Scanned/image PDFs are not supported yet."
)
TEXT_UNRECOGNISED_MESSAGE = "Could not find dated transactions in the PDF text."
MESSAGES_BATCH_NAME = "SMS inbox"
MESSAGES_BATCH_FAILED_MESSAGE = (
    "No new SMS transactions could be imported (all may already be present)."
)
MESSAGES_BATCH_PARTIAL_MESSAGE = (
    "Imported with %d alert(s) that could not be fully understood."
)
MESSAGES_NONE_RECOGNISED_MESSAGE = (
    "No bank or UPI transaction alerts were recognised in the scanned SMS."
)

# --- report constants ---------------------------------------------------------

RECENT_ROWS = 8
TOP_CATEGORIES = 4
TOP_SLICES = 5
REST_SHARE_FLOOR = 0.01
AMOUNT_PRESETS = [500, 1000, 5000]
