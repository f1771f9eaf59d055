"""Patterns and word lists of Philippine receipts.

Fixed values: results depend on them to the letter, so they are stated plainly and kept together. All are
searched case-insensitively unless their user says otherwise.
"""

# --- Receipt types, by priority: chain names, then layout markers -------------------------------------

SIGNATURES = {
    "pharmacy_column": (
        [r"MERCURY\s+DRUG", r"ROSE\s+PHARMACY", "GENERIKA", "WATSONS", r"SOUTH\s+STAR\s+DRUG", r"THE\s+GENERICS\s+PHARMACY", "FARMACIA", "BOTICA"],
        [r"^PA\s*#?\s*\d+", r"LESS\s*:?\s*BP\s+DISC", r"LESS\s*:?\s*SC\s+DISC", "Phillogix", r"VAT\s*REG\s*TIN\s*:\s*000-388"],
    ),
    "supermarket": (
        [r"SM\s+SUPERMARKET", r"SM\s+SAVEMORE", "PUREGOLD", r"S&R\s+MEMBERSHIP", "SHOPWISE", r"ROBINSONS\s+SUPERMARKET", r"WALTER\s+MART", r"PRICE\s+SMART", r"LANDERS\s+SUPERSTORE"],
        [r"^\*{1,3}\s*\d+\s*item", r"^ITEMS?\s+PURCHAS", r"^PHP\s*$", r"Vincor\s+Nixdorf", r"MEMBER\s+N[AO](?:NE|ME|)"],
    ),
    "fast_food": (
        ["JOLLIBEE", "MCDONALD'?S", "CHOWKING", r"MANG\s+INASAL", "GREENWICH", r"RED\s+RIBBON", r"BURGER\s+KING", r"PIZZA\s+HUT", r"\bKFC\b", r"\bSUBWAY\b", "WENDY'?S", "POPEYES", "SHAKEYS", r"KENNY\s+ROGER'?S"],
        [r"^ORDER\s*#\s*\d", r"^TABLE\s*#?\s*\d", r"^DINE\s*[-\s]?IN\b", r"^TAKE\s*[-\s]?OUT\b", r"^DRIVE\s*[-\s]?THRU\b", r"^CASHIER\s*[:#]?\s*\d"],
    ),
    "department_store": (
        [r"SM\s+DEPARTMENT", r"NATIONAL\s+BOOKSTORE", r"\bLANDMARK\b", "RUSTAN'?S", r"THE\s+LANDMARK", r"METRO\s+GAISANO", r"GAISANO\s+MALL", r"\bROBINSONS\s+DEPARTMENT\b", "KULTURA"],
        [r"^ITEM\s+CODE\s*:", r"^DESCRIPTION\s+QTY\s+PRICE"],
    ),
}
STANDALONE_RATIO, INLINE_RATIO = 0.12, 0.18
SHAPE_PRICE = r"^\s*[₱P]?\s*[\d,]+\.\d{2}\s*[TXZVvy]?\s*$"
SHAPE_INLINE = r"^.+\s{2,}[₱P]?\s*[\d,]+\.\d{2}\s*[TXZ]?\s*$"

# --- Header fields ------------------------------------------------------------------------------------

SEPARATOR = r"^[\-\*\=\s\.]+$"
BANNER = r"^\*\*.*\*\*$"
MONTH = "(?:January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
ORDINAL = "(?:st|nd|rd|th)?"
DATES_FULL = [
    r"\b(\d{1,2}[/\-\.]\d{1,2}[/\-\.]\d{4})\b",
    r"\b(\d{4}[/\-\.]\d{2}[/\-\.]\d{2})\b",
    rf"\b(\d{{1,2}}{ORDINAL}\s+{MONTH}\.?,?\s+\d{{4}})\b",
    rf"\b({MONTH}\.?\s+\d{{1,2}}{ORDINAL},?\s+\d{{4}})\b",
    rf"\b(The\s+\d{{1,2}}{ORDINAL}\s+of\s+{MONTH},?\s+\d{{4}})\b",
]
DATES_SHORT_YEAR = [r"\b(\d{1,2}[/\-]\d{1,2}[/\-]\d{2})\b", rf"\b(\d{{1,2}}\s+{MONTH}\.?\s+\d{{2}})\b", rf"\b({MONTH}\.?\s+'?\d{{2}})\b"]
DATES_PARTIAL = [r"\b(\d{2}[/\-]\d{4})\b", rf"\b({MONTH}\.?\s+\d{{4}})\b", rf"\b(\d{{1,2}}{ORDINAL}\s+{MONTH})\b", rf"\b({MONTH}\.?\s+\d{{1,2}}{ORDINAL})\b"]
DATES_LAST = [r"\b(\d{1,2}/\d{1,2})\b"]
DATE_CONTEXT = r"\b(date|dated|issued|on|as\s+of|for)\b"
TXN_LINE = r"^TXN#?\d"
TXN_SQUASHED = r"TXN#?\d+[-](\d{2})(\d{2})\d{0,2}[\-](2\d)\d{2}:"
TIME = r"\b(\d{1,2}:\d{2}\s*[AP]M?)\b"
INVOICES = [
    r"\bSALESINVOICE\s*(\d{6,})",
    r"\bINVOICE\s*#\s*([A-Z0-9]{6,})",
    r"\bINVOICE\s*#\s*(\d{4,})",
    r"\bINVOICE\s*#\s*([A-Z0-9\-]{4,})",
    r"\b(?:OR|SI)\s*#\s*([A-Z0-9][A-Z0-9\-]{3,})",
    r"\b(?:O\.R\.|S\.I\.)\s*#?\s*:?\s*([A-Z0-9\-]{4,})",
    r"\b(?:OFFICIAL RECEIPT|SALES INVOICE|RECEIPT NO\.?)\s*#?\s*:?\s*([A-Z0-9\-]{4,})",
    r"\bSI\s+No\s*[:#]\s*(\d{4,})",
]
TRANSACTIONS = [r"\bTXN\s*#\s*(\w{4,})", r"\b(?:TRANSACTION|CONTROL)\s*(?:NO\.?|#)\s*:?\s*([A-Z0-9\-]{4,})"]
AMOUNT_AFTER = r"\s*[:\-]?\s*[₱P]?\s*([\d,]+\.\d{2})"
TOTAL_NAMES = [r"GRAND\s+TOTAL", r"TOTAL\s+AMOUNT\s+DUE", r"AMOUNT\s+DUE", r"TOTAL\s+PAYMENT", r"TOTAL\s+SALES", r"NET\s+AMOUNT", r"NET\s+SALES", r"(?<!\w)TOTAL"]
TOTAL_LINES = [r"GRAND\s+TOTAL", r"TOTAL\s+AMOUNT\s+DUE", r"TOTAL\s+AMOUNT", r"TOTAL\s+SALES", r"NET\s+AMOUNT", r"AMOUNT\s+DUE", "TOTAL", r"TOTAL\s+PAYMENT"]
VAT_NAMES = [r"(?:VAT\s*[-–]?\s*12%|12%\s*VAT|OUTPUT\s*TAX|VAT\s*AMOUNT)", "VAT"]
VAT_LINE = r"^(VAT\s*[-–]?\s*\d*\s*%?|VAT\s+AMOUNT|OUTPUT\s+TAX|VAT)\s*[:\-]?\s*$"
TINS = [r"(?:VAT\s+REG\s+)?TIN\s*[:\-]?\s*(\d{3}[\-\s]\d{3}[\-\s]\d{3}[\-\s\d]+)", r"TIN\s*[:\-]?\s*(\d{9,15})"]

# --- Item lines, shared -------------------------------------------------------------------------------

BARCODE = r"^\d{6,14}$"
QTY_LINE = r"^(\d{1,4})\s*[@xX×]\s*([\d,]+\.\d{2})\s*$"
QTY_AT_PRICE = r"^\d+\s*@\s*[\d,]+\.\d{2}$|\d+\s+@\s+[\d,]+\.\d{2}$"
PRICE_TAXED = r"^\s*[₱P]?\s*([\d,]+\.\d{1,2})\s*[TXZVvy]?\s*$"
PRICE_PLAIN = r"^\s*[₱P]?\s*([\d,]+\.\d{1,2})\s*$"
PRICE_LIKE = r"^[₱P]?\s*[\d\.,OIl]+\s*[TXZVvy]?\s*$"
INLINE_TAXED = r"^(.+?)\s{2,}[₱P]?\s*([\d,]+\.\d{2})[TXZ]?\s*$"
INLINE_PLAIN = r"^(.+?)\s{2,}[₱P]?\s*([\d,]+\.\d{2})\s*$"
PERCENT_LINE = r"^(VAT|TAX|DISC)\s*[-–]?\s*\d+\s*%"
ITEM_COUNT = r"\*+\s*(\d+)\s*item(?:s|\(s\))?\s*\**"

# --- Generic and inline layouts -----------------------------------------------------------------------

ZONE_END = r"^(SUBTOTAL|SUB\s*TOTAL|GRAND\s*TOTAL|CHANGE|CHANGE\s*DUE|AMOUNT\s*TENDERED|CASH\s*TENDERED|TOTAL\s*PAYMENT)\s*[:\-]?\s*$"
FINANCIAL = r"^(SUBTOTAL|SUB\s*TOTAL|GRAND\s*TOTAL|TOTAL\s*AMOUNT|AMOUNT\s*DUE|TOTAL\s*PAYMENT|TOTAL\s*SALES|NET\s*AMOUNT|CASH\s*TENDERED|AMOUNT\s*TENDERED|CHANGE|BALANCE|CASH|DEBIT|CREDIT|VAT|TAX|DISCOUNT|TOTAL|VATABLE|VAT\s*EXEMPT|ZERO\s*RATED|OUTPUT\s*TAX)\s*[:\-₱P\d\.]*\s*$"
PAYMENT = r"^(GCASH|MAYA|PAYMAYA|VISA|MASTERCARD|AMEX|JCB|BDO|BPI|METROBANK|DEBIT\s*CARD|CREDIT\s*CARD|CHECK|CHEQUE|VOUCHER|E\s*WALLET|SOLD\s*TO|MEMBER\s+N|ITEMS?\s+PURCHAS)"
SKIP_WORDS = r"\b(TOTAL|SUBTOTAL|CHANGE|CASH|PAYMENT|TENDERED|DISCOUNT|VAT|TAX|BALANCE|DUE|PAID|AMOUNT|VOID|REFUND|THANK|WELCOME|PLEASE|COME|AGAIN|DEBIT|CREDIT|NET|GROSS|INVOICE|RECEIPT)\b"
DEFINITIVE = r"^(CHANGE|CASH\s+TENDERED|AMOUNT\s+TENDERED|TOTAL\s+PAYMENT|TOTAL\s+AMOUNT|NET\s+AMOUNT|AMOUNT\s+DUE|GRAND\s+TOTAL|CASH|TOTAL\s+SALES)\s*[:\-]?\s*$"

# --- Fast food ----------------------------------------------------------------------------------------

FF_QTY = r"^(\d{1,2})\s+(.+?)\s{2,}[₱P]?\s*([\d,]+\.\d{2})\s*$"
FF_SKIP = r"\b(TOTAL|SUBTOTAL|CHANGE|CASH|PAYMENT|TENDERED|DISCOUNT|VAT|TAX|BALANCE|DUE|PAID|AMOUNT|VOID|REFUND|TIN|DATE|TIME|THANK|WELCOME|CASHIER|ORDER|TABLE|DINE|TAKE|DRIVE|DEBIT|CREDIT|INVOICE|RECEIPT)\b"
FF_END = r"^(SUBTOTAL|SUB\s*TOTAL|GRAND\s*TOTAL|CHANGE|TOTAL)\s*[:\-]?\s*$"
FF_HEADER = r"^(ORDER\s*#|TABLE\s*#|CASHIER\s*#|DINE\s*IN|TAKE\s*OUT|DRIVE\s*THRU)"
NARROW_DEFINITIVE = r"^(CHANGE|CASH\s+TENDERED|AMOUNT\s+TENDERED|TOTAL\s+PAYMENT|TOTAL\s+AMOUNT|NET\s+AMOUNT|AMOUNT\s+DUE|GRAND\s+TOTAL|CASH)\s*[:\-]?\s*$"

# --- Department store ---------------------------------------------------------------------------------

DS_QTY = r"^(.+?)\s{2,}(\d{1,3})\s{1,4}[₱P]?\s*([\d,]+\.\d{2})\s*$"
DS_END = r"^(SUBTOTAL|SUB\s*TOTAL|GRAND\s*TOTAL|CHANGE|TOTAL\s*AMOUNT|AMOUNT\s*DUE|NET\s*AMOUNT)\s*[:\-]?\s*$"
DS_SKIP = r"\b(TOTAL|SUBTOTAL|CHANGE|CASH|PAYMENT|TENDERED|DISCOUNT|VAT|TAX|BALANCE|DUE|PAID|AMOUNT|VOID|REFUND|THANK|WELCOME|DEBIT|CREDIT|INVOICE|RECEIPT|SECTION|DEPARTMENT|CATEGORY)\b"

# --- Supermarket --------------------------------------------------------------------------------------

SM_START = r"^PH[PO]\s*$"
SM_INLINE_QTY = r"^(.+?)\s{2,}(\d{1,4}\s*[@xX×]\s*[\d,]+\.\d{2})\s*$"
SM_SKIP = r"\b(TOTAL|SUBTOTAL|CHANGE|CASH|CARD|PAYMENT|TENDERED|DISCOUNT|LESS|VAT|TAX|BALANCE|DUE|PAID|AMOUNT|VOID|REFUND|TIN|DATE|TIME|CASHIER|THANK|WELCOME|PLEASE|COME|AGAIN|SAVE|SENIOR|PWD|MEMBER|POINTS|LOYALTY|DEBIT|CREDIT|NET|GROSS|INVOICE|SOLD|ADDRESS|VATAble|Exempt|Zero|Rated|RECEIPT|YOUR|THIS|MERCHANDISE|CONDITION|SALAMAT|MARAMING|items?)\b"
SM_FINANCIAL = r"^(SUBTOTAL|SUB\s*TOTAL|GRAND\s*TOTAL|TOTAL\s*AMOUNT|AMOUNT\s*DUE|TOTAL\s*PAYMENT|TOTAL\s*SALES|NET\s*AMOUNT|CASH\s*TENDERED|AMOUNT\s*TENDERED|CHANGE|BALANCE|CASH|DEBIT|CREDIT|VAT|TAX|DISCOUNT|TOTAL|VATABLE|VAT\s*EXEMPT|ZERO\s*RATED)\s*[:\-₱P\d\.]*\s*$"
SM_PAYMENT = r"^(GCASH|MAYA|PAYMAYA|VISA|MASTERCARD|AMEX|JCB|BDO|BPI|METROBANK|DEBIT\s*CARD|CREDIT\s*CARD|CHECK|CHEQUE|VOUCHER|E\s*WALLET|MEMBER\s+N|ITEMS?\s+PURCHAS|SOLDTO|SOLD\s*TO|NAME\s*:\s*$|TIN\s*NO|ADDRESS)"

# --- Pharmacy -----------------------------------------------------------------------------------------

RX_MODE = r"^PA\s*#?\s*\d+\s*S/S$|^PA\s*#?\s*\d+\s*\w{0,8}$|^PA\s*#\s*\d+\s+[A-Za-z][A-Za-z-]{0,12}$"
RX_START = r"^PHP\s*$"
RX_HEADER = r"^(VAT\s+REG\s+TIN|TEL\s*NO|MOBILE|TOSHIBA|MTN:|MIN\d|VIBER|Brgy\.|Barangay|MOBILE/VIBER|IBM\d|\d{3}-\d{3}-\d{3})"
RX_JUNK = r"^\*[A-Z]{1,4}$|^\([TXZSE]\)$|LESS\s*:?\s*BP\s*DISC|LESSBPDISC|^LESS\b.*\bDISC\b|^\*{1,2}[A-Z0-9\s]{1,6}\*{0,2}$|^[\(\[][TXZSEPWDB]{1,3}[\)\]]$"
RX_PAYMENT = (
    r"^(CRED\s*CRD|CRED\s*CARD|DEBIT\s*CRD|DEBIT\s*CARD|GCASH|G\s*CASH|PAYMAYA|MAYA|PAYPAL|UNIONPAY|VISA|MASTERCARD|AMEX|JCB|BDO|BPI|METROBANK|CHINABANK|RCBC|PNB|LANDBANK|DBP|CHECK|CHEQUE|VOUCHER|E\s*WALLET|EWALLET|APPROVAL|APPROVAL\s*#|ORDER\s*#|CARD\s*#|SOLD\s*TO|SOLDTO|PAYMAYA|SUKI\s*#|NAME\s*:).*$"
    r"|^MEMBER\s+N[AO](?:NE|ME|)\b|^ITEMS?\s+PURCHAS|^VAT(?:ABLE|EBLE|ABLE|EABLE)?\s*SALE|^VAT(?:\s*EXEMPT|\s*ZERO|\s*\()|^ZERO\s+RATED\s+SALE|^VAT\s+EXEMPT\s+SALE|^(NANE|NANS|NAME|ADDRESS|TIN|BUSINESS\s*STYLE)\s*:\s*$"
)
RX_METADATA = (
    r"^(TOSHIBA|POSTEK|EPSON|CASIO|NCR|SAMSUNG)\b|^MIN\d{10,}|\[\d+\.\d+\.\d+\]|^Phillogix|^433\s*Lt\.?\s*Artiaga|^PTU\s*No\.?|^Accred\s*No|^VAT\s*REG\s*TIN\s*\d|^Approva[l1]\s*#|^Card\s*#\s*\*+|^PWDID\s*#|^SUKI\s*#|^NAME\s*:.*\*"
    r"|^(SIGNATURE|SOLD\s*TO|ADDRESS|TIN\s*NO|BUSINES\s*STYLE)\s*:?\s*_{0,}$|^-{5,}$|^={5,}$|^NAME[\:\s].*\*{3,}|^SN#\S+|^Vincor\s+Nixdorf|^SALESINVOICE\d|^\d{9,}[A-Z]{2,}|^[A-Z]\d{2,}[A-Z]\d+[A-Z]\d+|^O\s+Lite\s*$"
)
RX_SKIP = r"\b(TOTAL|SUBTOTAL|CHANGE|CASH|CARD|PAYMENT|TENDERED|DISCOUNT|LESS|VAT|TAX|BALANCE|DUE|PAID|AMOUNT|VOID|REFUND|TIN|DATE|TIME|CASHIER|THANK|WELCOME|PLEASE|COME|AGAIN|SAVE|SENIOR|PWD|MEMBER|POINTS|LOYALTY|DEBIT|CREDIT|NET|GROSS|INVOICE|INVOI|SOLD|ADDRESS|VATAble|Exempt|Zero|Rated|Phillogix|Accred|PTU|MIN|TXN|TOSHIBA|MOBILE|VIBER|BRGY|BARANGAY|RECEIPT|YOUR|THIS|MERCHANDISE|CONDITION|SALAMAT|MARAMING|LAGING|NAKASISIGURO|GAMOT|BAGO|SUKI|items?)\b"
RX_FINANCIAL = r"^(SUBTOTAL|SUBTOIAL|SUBT0TAL|SUB\s*TOTAL|GRAND\s*TOTAL|TOTAL\s*AMOUNT|AMOUNT\s*DUE|TOTAL\s*PAYMENT|TOTAL\s*SALES|NET\s*AMOUNT|NET\s*SALES|CASH\s*TENDERED|AMOUNT\s*TENDERED|TOTAL\s*TENDERED|CHANGE|CHANG3|CH4NGE|BALANCE|CASH|DEBIT|CREDIT|VAT|TAX|DISCOUNT|VATABLE|VAT[\s\-]*EXEMPT|ZERO[\s\-]*RATED|OUTPUT\s*TAX|TOTAL|TOTAI|T0TAL|T0TAI|T0TALS?|VAT\s*[-–]?\s*\d+%?)\s*[:\-₱P\d\.]*\s*$"
RX_UNITS = r"(\d+\.?\d*\s*(?:ML|L|KG|G|MG|PCS|PC|TAB|CAP|TABS|CAPS|BOX|BTL|PKT|PCK|SACHET|POUCH|ROLL|PAIR|SET|SHEET|BAG|CAN|JAR|TUB|TUBE|OZ|LB|GM|GMS|KCAL|MCG|IU)|(?<![A-Za-z])(?:ML|KG|MG|PCS|TAB|TABS|CAPS|CAP|BOX|BTL|PKT|PCK|SACHET|POUCH|ROLL|PAIR|SET|BAG|CAN|JAR|TUB|TUBE|OZ|LB|GM|GMS)(?![A-Za-z]))"
RX_CODE = r"(?<![A-Za-z])([A-Z]{2,}\d+|\d+[A-Z]{2,})(?![A-Za-z%])"
RX_PERCENT = r"^(VAT|TAX|DISC|DISCOUNT)\s*[-–]?\s*\d+\s*%"
RX_SHORT_CODE = r"^\d{1,5}[-/]?[A-Za-z0-9]{0,3}$"
RX_TAXED = r"^[₱P]?\s*[\d,]+\.\d{2}[TXZ]$"
RX_TOTAL_LABEL = r"^(TOTAL|SUB\s*TOTAL|GRAND\s*TOTAL)\s*[:\-\.]?\s*$"
RX_DISCOUNT_PRICE = r"(?:LESS|BPDISC|BP\s*DISC)[^x×X]*[x×X]\s*([\d,]+\.?\d{0,2})"
RX_ITEMS_PURCHASED = r"ITEMS?\s+PURCHAS(?:ED|EO|E)\s*[:#]?\s*(\d+)"

# --- Orientation keywords -----------------------------------------------------------------------------

HEADER_KEYWORDS = ["MERCURY DRUG", "SM SUPERMARKET", "SM HYPERMARKET", "JOLLIBEE", "MCDONALD", "7-ELEVEN", "MINISTOP", "WATSONS", "ROSE PHARMACY", "GENERIKA", "SOUTH STAR", "ROBINSONS", "PUREGOLD", "SAVEMORE", "LANDMARK", "MANSON"]
FOOTER_KEYWORDS = ["THIS IS YOUR INVOICE", "- THIS IS YOUR INVOICE -", "TXN#", "INVOICE#", "PTU NO", "PTU No.", "ACCRED NO", "PHILLOGIX", "MARAMING SALAMAT", "SALAMAT PO", "THANK YOU FOR"]

# --- Corrections: (pattern, replacement, ignore case), in order ----------------------------------------

CORRECT_SYMBOLS = [
    (r"(?<![A-Z])P\s*(\d[\d,]*\.\d{2})", "₱$1", False),
    (r"¥\s*(\d[\d,]*\.\d{2})", "₱$1", False),
    (r"(\d)\s+[xX]\s+(\d)", "$1 × $2", False),
    (r"(\d)_(\d)", "$1-$2", False),
]
CORRECT_WORDS = [
    (r"([A-Z]{2,})([A-Z][a-z])", "$1 $2", False),
    (r"([a-z])([A-Z])", "$1 $2", False),
    *((rf"\b{p}([A-Z][a-z])", f"{p} $1", False) for p in ("SAN", "SANTA", "ST", "AVE", "BRGY")),
    *((rf"([A-Z]{{3,}}){s}\b", f"$1 {s}", False) for s in ("CARE", "SUPPORT", "SERVICE", "CENTER", "STORE")),
    (r"(\d{4,})([A-Z][a-z])", "$1 $2", False),
    (r"\bMIN\b", "MTN", False),
    (r"(ID)#(\d)", "$1# : $2", False),
    (r"\b(Sa)\s+([a-z]{3,})\b", "$1$2", False),
    (r"\bTele\s+phone\b", "Telephone", True),
    (r"\bInter\s+national\b", "International", True),
]
ENHANCE = [
    (r"MIN\s*:\s*(\d)", "MTN:$1", True),
    (r"(\d{4})\s+(\d{4})-(\d{4})", "$1$2$3", True),
    (r"(MOBILE/VIBER)\s+N0(\d{4})\)", "$1 NO : (0$2)", True),
    (r"PWDID#(\d)", "PWD ID# : $1", True),
    (r"Phil\s+logix", "Phillogix", True),
    (r"Sa\s+lamat", "Salamat", True),
    (r"NID05\+", "NIDO5+", True),
    (r"Accred\s+No\.", "Acct'd No.", True),
    (r"(\d{3,4})(\d{3,4})-?(\d{4})", "$1 $2-$3", True),
    (r"(\d{3})-?(\d{3})-?(\d{3})-?(\d{5})", "$1-$2-$3-$4", True),
    (r"(VAT)\s*-?\s*(\d+%)", "$1 $2", True),
    (r"TEL\s*NO\s*:?\s*\(?(\d{3,4})\)?", "TEL NO : ($1)", True),
    (r"(MOBILE)\d+(VIBER)", "$1/$2", True),
    (r"(MOBILE)(VIBER)", "$1/$2", True),
    (r"(\d+)\s*(item)([^s]|$)", "$1 $2$3", True),
    (r"(\d+)\s*(items)", "$1 $2", True),
    (r"\*\*\s*(\d+)\s*items?\s*\*\*", "** $1 item(s) **", True),
    (r"LESS\s*:?\s*BP\s*DISC", "LESS : BP DISC", True),
    (r"([A-Z]{2,})(:)(\d)", "$1 $2 $3", True),
    (r"(PWD\s+ID#)\s*:?\s*(\d)", "$1 : $2", True),
    (r"(\d+%)\s*x\s*(\d)", "$1 x $2", True),
]

# --- Gates: what any line must have before the patterns of a field are tried (ours, not fixed values) --------

GATE_DATE = r"\d[/\-]\d|\d\.\d{1,2}[/\-\.]\d"
GATE_TIN = "TIN"
GATE_TIME = r"\d:\d\d"
#: Parts in capitals, of which a line must hold one.
GATE_INVOICE = ("#", "NVO", "RECE", "O.R.", "S.", "NO", "TXN", "TRANSACT", "CONTROL")
GATE_MONTH = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
GATE_TOTAL, GATE_VAT = ("TOTAL", "AMOUNT", "NET"), ("VAT", "TAX")
