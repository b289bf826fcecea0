"""The vocabulary that results must match exactly."""

# Case statuses.
STATUSES = [
    "準備中", "待送件", "已送件", "審查中", "補件", "打字中", "校對中", "核准發文中", "可自領", "郵寄",
    "電子送達", "已領件", "國稅局辦理", "結案", "取消", "待補資料", "資料確認", "送件中", "核准",
]
CLOSED = ["結案", "取消"]
NEVER_STALE = ["補件", "可自領"]
PROTECTED = ["已領件", "國稅局辦理", "結案", "取消"]
PREPARING = ["準備中", "待補資料", "資料確認", "待送件"]
GOVERNMENT = ["已送件", "送件中", "審查中", "補件", "打字中", "校對中", "核准發文中", "可自領"]
STATUS_TONES = {
    "prep": PREPARING,
    "attention": ["補件"],
    "ready": ["可自領", "郵寄", "電子送達", "核准"],
    "tax": ["已領件", "國稅局辦理"],
    "done": CLOSED,
}

# Other enumerations.
ENTITY_TYPES = ["公司", "行號"]
TAX_OFFICE_VALUES = ["未確認", "需要", "辦理中", "不需要", "已完成"]
TAX_OFFICE_LABELS = {
    "未確認": "尚未確認", "需要": "待辦國稅局", "辦理中": "國稅局辦理中", "不需要": "免送國稅局", "已完成": "國稅局已完成",
}
BILLING_STATUSES = ["未請款", "已請款", "已收款"]
APPROVAL_STATUSES = ["not_received", "received", "archived"]
AGENCIES = ["city_government", "national_tax"]

# External progress wording -> case status; the first that matches wins.
OFFICIAL_STATUS_RULES = [
    ("可自領", "可自領"), ("已郵寄|郵寄", "郵寄"), ("電子送達", "電子送達"), ("補正|補件", "補件"), ("打字", "打字中"),
    ("校對", "校對中"), ("審查", "審查中"), ("發文中", "核准發文中"), ("核准", "核准"),
]
OFFICIAL_STATUS_DEFAULT = "已送件"

# Tax bureaus and their counties, in matching order.
BUREAUS = [
    ("A05", "臺北國稅局", "台北", ["臺北市"]),
    ("H01", "北區國稅局", "北區", ["新北市", "桃園市", "新竹市", "新竹縣", "基隆市", "宜蘭縣", "花蓮縣", "金門縣", "連江縣"]),
    ("B01", "中區國稅局", "中區", ["苗栗縣", "臺中市", "彰化縣", "南投縣", "雲林縣"]),
    ("D01", "南區國稅局", "南區", ["嘉義縣", "嘉義市", "臺南市", "屏東縣", "臺東縣", "澎湖縣"]),
    ("E01", "高雄國稅局", "高雄", ["高雄市"]),
]
COUNTIES = [county for _, _, _, counties in BUREAUS for county in counties]

# Letter values of a national identity number.
ID_LETTER_VALUES = {
    "A": 10, "B": 11, "C": 12, "D": 13, "E": 14, "F": 15, "G": 16, "H": 17, "I": 34, "J": 18, "K": 19, "L": 20, "M": 21,
    "N": 22, "O": 35, "P": 23, "Q": 24, "R": 25, "S": 26, "T": 27, "U": 28, "V": 29, "W": 32, "X": 30, "Y": 31, "Z": 33,
}

# Simplified glyphs and the traditional ones they stand for.
SIMPLIFIED = "换发证号税别县镇乡邻里区街楼层务义国湾台"
TRADITIONAL = "換發證號稅別縣鎮鄉鄰里區街樓層務義國灣臺"

# Words that are labels, not names.
NAME_EXCLUSIONS_TEXT = ["中華民國", "出生日期", "身分證字號", "統一編號", "發證日期", "戶籍地址", "住址", "國籍", "姓名"]
NAME_EXCLUSIONS_TOKENS = [
    "中華民國", "國民身分證", "姓名", "出生日期", "發證日期", "父", "母", "配偶", "役別", "出生地", "住址", "地址", "國籍",
    "年月日", "年月", "年日", "月日", "性別", "性别女", "女性",
]
NAME_STOP_TERMS = "地址|國籍|出生|日期|身分證|民國"

# Address candidate scoring.
ADDRESS_TARGET_CONTEXTS = ["租賃標的", "房屋所在地", "租賃地址", "標的物", "坐落"]
ADDRESS_NEGATIVE_CONTEXTS = ["出租人", "承租人", "戶籍", "通訊", "聯絡地址", "戶籍地址", "通訊地址"]
ADDRESS_PERSON_TERMS = "姓名|身分證|出生"
ADDRESS_CONTEXT_CHARS = 28
ADDRESS_PATTERN = (
    r"(?:\d{3,5}\s*)?(?:臺灣省)?"
    r"(?:臺北市|新北市|桃園市|臺中市|台中市|臺南市|台南市|高雄市|基隆市|新竹市|嘉義市|新竹縣|苗栗縣|彰化縣|南投縣|雲林縣|嘉義縣|屏東縣|宜蘭縣|花蓮縣|臺東縣|台東縣|澎湖縣|金門縣|連江縣)"
    r"[一-鿿]{1,8}(?:區|鄉|鎮|市)"
    r"(?:[一-鿿A-Za-z0-9０-９一二三四五六七八九十百甲乙丙丁之、．.\-]{1,30})(?:路|街|大道|巷|弄|號|樓)"
    r"(?:[一-鿿A-Za-z0-9０-９一二三四五六七八九十百之、．.\-]{0,24})"
)

# Document types found on pages, with their keywords.
DOCUMENT_TYPES = [
    ("lease", "租約", ["租賃契約", "租賃標的", "出租人", "承租人"]),
    ("house_tax", "房屋稅單", ["房屋稅繳款書", "房屋稅", "房屋稅籍"]),
    ("land_title", "土地權狀", ["土地所有權狀", "建物所有權狀", "土地權狀", "地號", "權利範圍"]),
    ("building_consent", "建物所有人同意書", ["建物所有人同意", "房屋使用同意", "使用同意書", "同意作為公司登記"]),
    ("floor_plan", "平面圖", ["平面圖", "位置圖", "配置圖", "比例尺", "圖例"]),
]
CHECKLIST_PATTERN = "文件簽收確認單|提供以下資料|逐一核對"
CHECKLIST_EXEMPT_KEY = "lease"

# Category of a file by its name; the first pattern that matches wins.
FILE_CATEGORIES = [
    ("tax_registration", "(?:房屋)?稅籍證明"),
    ("building_transcript", "建物.*謄本"),
    ("building_title", "建物.*(?:所[有以]權狀|權狀)|所有權狀"),
    ("house_tax", "房屋稅"),
    ("precheck", "(?:名稱.*預查|預查.*(?:核定|名稱|表))"),
]
ALLOWED_SUFFIXES = [".pdf", ".jpg", ".jpeg", ".png", ".tif", ".tiff"]
SKIPPED_CATEGORIES = ["precheck"]

# Property fields, their labels and how far down a page each category is read.
FIELD_LABELS = {
    "property_address": ["課稅房屋坐落", "房屋坐落", "建物門牌", "坐落地址"],
    "tax_registration_number": ["房屋稅籍編號", "稅籍編號", "稅籍號碼"],
}
LABEL_MATCH_MINIMUM = 0.68
BOTTOM_RATIOS = {"tax_registration": 0.50, "house_tax": 0.48, "building_transcript": 0.68, "building_title": 0.72}

# Words on either side of an identity card.
FRONT_WORDS = ["國民身分證", "姓名", "出生日期", "國籍"]
BACK_WORDS = ["住址", "父", "母", "配偶", "役別", "出生地"]
ADDRESS_NEIGHBOUR_LABELS = ["父", "母", "配偶", "役別", "出生地", "統一編號", "姓名"]
ISSUE_MARKER = "發證|[換補初]發"
MINIMUM_ISSUE_AGE = 14

# Which fields a scan of each side must and may carry.
SIDE_FIELDS = {
    "back": (["地址"], ["證號"]),
    "front": (["姓名", "證號"], ["生日"]),
    "auto": (["姓名", "證號"], ["生日", "地址"]),
}

# Wording of a shareholder consent; {name} marks a value of the case.
CONSENT_BLANK = "＿＿＿＿＿＿"
CONSENT_TOPICS = [
    ("incorporation", "setup", "公司設立", "茲同意設立{company}，訂定公司章程，並選任{directors}為董事。"),
    ("articles_amendment", "change", "修正公司章程", "茲同意修改公司章程如所附章程修正條文對照表。"),
    ("director_appointment", "change", "董事、董事長選任", "茲同意改推{directors}為董事，{chairman}為董事長，對外代表本公司。"),
    ("address_change", "change", "公司所在地變更", "茲同意本公司所在地遷至{registration_address}，並同意修正公司章程如所附章程修正條文對照表。"),
    ("name_change", "change", "公司名稱變更", "茲同意本公司更名為{company}，並同意修正公司章程如所附章程修正條文對照表。"),
    ("business_change", "change", "公司所營事業變更", "茲同意公司所營事業變更，並同意修正公司章程如所附章程修正條文對照表。"),
    ("capital_increase", "change", "增資", "茲同意本公司增資新臺幣{capital}元，{contributions}。"),
]

# What an office must fill in before a purchase proof is written.
OFFICE_REQUIRED = [
    ("unified_number", "統一編號"), ("responsible_person", "負責人"), ("responsible_person_id", "負責人身分證字號"),
    ("address", "地址"), ("phone", "電話"), ("media_code", "媒體代號"), ("license_number", "證書字號"),
]

# The boxes ticked on a purchase proof that has no settings yet.
PROOF_CHECKBOXES = {
    "page1": {
        "registration": {"establishment": True, "change": False, "other": False},
        "reason": {"new": True, "change": False, "lost": False, "damaged": False, "other": False},
        "attachments": {"responsibleIdOriginal": False, "agentPickup": True},
        "relation": {"responsible": False, "agent": False, "employee": False, "otherOffice": True},
        "invoiceTypes": {"twoCopy": True, "threeCopy": True, "twoCopyRegister": False, "threeCopyRegister": False, "special": False},
    },
    "page2": {
        "services": {"purchase": True, "receiveCertificate": True},
        "qualification": {"accountant": False, "bookkeeper": True, "taxAgent": False},
        "actions": {"purchase": True, "receiveCertificate": True},
    },
}

# Public progress pages.
BUSINESS_LIST_URL = "https://serv.gcis.nat.gov.tw/caseSearch/list/QueryBusmCaseList/queryBusmCaseList.do"
BUSINESS_DETAIL_URL = "https://serv.gcis.nat.gov.tw/caseSearch/detail/QueryBusmCaseDetail/queryBusmCaseDetail.do"
COMPANY_DETAIL_URL = "https://serv.gcis.nat.gov.tw/caseSearch/detail/QueryCsmmCaseDetail/queryCsmmCaseDetail.do"
