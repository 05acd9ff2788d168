"""Rule tables.  Operators take rules as data; these are the defaults.

Rules are ordered: the first that fits wins.  ``NEUTRAL_*`` tables fit Latin-script text.
"""

from __future__ import annotations

# Number words, patterns and word lists of the document conventions served.
CN = "一二三四五六七八九十"

SECTION_PATTERNS = [
    rf"^第[{CN}\d]+章[：:\s]*(.+)",
    rf"^第[{CN}\d]+节[：:\s]*(.+)",
    rf"^第[{CN}\d]+部分[：:\s]*(.+)",
    rf"^[{CN}\d]+[、，\.\s]+(.+)",
    r"^[1-9]\d*[、\.\s]+(.+)",
    r"^\([1-9]\d*\)[\s：:](.+)",
    r"^[A-Z]\.[\s：:](.+)",
]
CLAUSE_PATTERNS = [
    rf"^第[{CN}\d]+条[：:\s]*(.+)",
    r"^[1-9]\d+\.[1-9]\d*(\.[1-9]\d*)?[、\.\s]+(.+)",
    r"^[1-9]\d+[\s、:：](.+)",
    r"^[1-9]\d+\.[1-9]\d*\s*(.+)",
]
ITEM_PATTERNS = [
    rf"^[（\(][{CN}\d]+[）\)][\s：:](.+)",
    r"^\([1-9]\d*\)[\s：:](.+)",
    r"^[1-9]\d+\)[\s：:](.+)",
    r"^[a-zA-Z]\)[\s：:](.+)",
    r"^[①②③④⑤⑥⑦⑧⑨⑩][\s：:](.+)",
]
NODE_SECTION = rf"第[{CN}\d]+章|第[{CN}\d]+节|第[{CN}\d]+部分"
NODE_CLAUSE = rf"第[{CN}\d]+条|^\d+[\.\s]|^\d+\.\d+"
NODE_ITEM = rf"^[（\(][{CN}\d]+[）\)]|^\(\d+\)|^\d+\)|^[a-zA-Z]\)|^[①②③④⑤⑥⑦⑧⑨⑩]"
NUMBER_TITLE_PATTERNS = [
    rf"^(第[{CN}\d]+[章节条款部分])[：:\s]*(.+)",
    rf"^([（\(][{CN}\d]+[）\)])[\s：:]*(.+)",
    r"^(\(\d+\))[\s：:]*(.+)",
    r"^(\d+\))[\s：:]*(.+)",
    r"^([a-zA-Z]\))[\s：:]*(.+)",
    r"^([①②③④⑤⑥⑦⑧⑨⑩])[\s：:]*(.+)",
    r"^(\d+)[\.\s]+(.+)",
    r"^(\d+\.\d+)[\.\s]+(.+)",
]
HEADING_PATTERNS = [(rf"^第[{CN}\d]+[章节条款部分]", 1), (r"^[\d]+\.", 3), (rf"^[{CN}]+[、．]", 3), (r"^[（\(]\d+[）\)]", 3), (rf"^[（\(][{CN}]+[）\)]", 3)]
LIST_PATTERNS = [r"^[\d]+\.[\s]", r"^[（\(]\d+[）\)][\s]", r"^[•·○●□■▪▫]", r"^[a-zA-Z]\.[\s]"]

REGION_WORDS = [
    ("TOC", ["目录", "目 录", "table of contents"]),
    ("COVER", ["合同", "协议", "协议编号", "甲方", "乙方", "签订日期", "签订地点"]),
    ("SIGN", ["签字", "签署", "法定代表人", "授权代表", "日期"]),
    ("APPENDIX", ["附件", "附录", "补充协议", "附表"]),
]
BODY_WORDS = ["约定", "应当", "有权", "义务", "责任", "禁止", "定义"]
NC_TYPE_WORDS = {
    "COVER": [("TITLE", ["合同名称", "协议名称", "标题"]), ("PARTIES", ["甲方", "乙方", "当事人", "公司"])],
    "MAIN": [("TITLE", ["第", "条", "款", "章", "节"]), ("CLAUSE_BODY", BODY_WORDS)],
    "APPENDIX": [("TITLE", ["附件", "附录", "补充"]), ("CLAUSE_BODY", BODY_WORDS)],
    "SIGN": [("PARTIES", ["甲方", "乙方", "当事人", "公司"]), ("TITLE", ["签字", "签署"])],
}
ROLE_WORDS = [*BODY_WORDS, "权利", "承诺", "保证", "赔偿", "违约", "解除", "终止", "履行", "支付", "交付", "提供", "承担", "遵守", "符合"]
ROLE_PATTERN = rf"第[{CN}\d]+条|^\d+[\.\s]|^\d+\.\d+"

DOCUMENT_TYPES = [
    ("CONTRACT", ["合同", "合约", "contract", "agreement"]),
    ("AGREEMENT", ["协议", "agreement", "pact", "accord"]),
    ("REGULATION", ["规定", "条例", "办法", "regulation", "rule", "ordinance"]),
    ("POLICY", ["政策", "policy", "guideline", "strategy"]),
    ("LAW", ["法", "法律", "law", "act", "statute", "legislation"]),
]
CONTRACT_DOMAINS = [
    ("PROPERTY", ["房产", "房屋", "土地", "不动产", "租赁", "买卖", "property", "real estate", "lease", "rental"]),
    ("FINANCE", ["金融", "贷款", "融资", "投资", "资金", "finance", "loan", "investment", "funding"]),
    ("INTELLECTUAL_PROPERTY", ["知识产权", "专利", "商标", "版权", "intellectual property", "patent", "trademark", "copyright"]),
    ("EMPLOYMENT", ["雇佣", "劳动", "员工", "工作", "employment", "labor", "employee", "work"]),
    ("CORPORATE", ["公司", "股权", "股东", "董事会", "corporate", "shareholder", "stock", "equity"]),
    ("PROCUREMENT", ["采购", "供应", "招标", "procurement", "purchase", "supply", "tender"]),
    ("PARTNERSHIP", ["合作", "合伙", "合资", "partnership", "cooperation", "joint venture"]),
]
CLAUSE_CATEGORIES = [
    ("DEFINITION", ["定义", "解释", "含义", "definition", "interpretation", "meaning"]),
    ("SCOPE", ["范围", "适用", "scope", "application", "applicability"]),
    ("OBLIGATION", ["义务", "责任", "职责", "obligation", "duty", "responsibility"]),
    ("RIGHT", ["权利", "权益", "right", "entitlement", "privilege"]),
    ("LIABILITY", ["责任", "赔偿", "损失", "liability", "compensation", "damages"]),
    ("TERM", ["期限", "时间", "有效期", "term", "duration", "validity period"]),
    ("PAYMENT", ["支付", "付款", "费用", "payment", "pay", "fee", "cost"]),
    ("TERMINATION", ["终止", "解除", "结束", "termination", "end", "cancellation"]),
    ("DISPUTE", ["争议", "纠纷", "仲裁", "dispute", "controversy", "arbitration"]),
    ("CONFIDENTIALITY", ["保密", "机密", "confidentiality", "secret", "non-disclosure"]),
    ("INTELLECTUAL_PROPERTY", ["知识产权", "专利", "商标", "版权", "intellectual property", "patent", "trademark", "copyright"]),
    ("FORCE_MAJEURE", ["不可抗力", "天灾", "force majeure", "act of god", "natural disaster"]),
    ("GOVERNING_LAW", ["管辖法律", "适用法律", "法律适用", "governing law", "applicable law"]),
]
TAG_PATTERNS = {
    "party": [rf"{who}[：:]\s*([^，,。\n]+)" for who in ("甲方", "乙方", "丙方", "委托方", "受托方", "承租方", "出租方")],
    "date": [r"(\d{4}年\d{1,2}月\d{1,2}日)", r"(\d{4}年\d{1,2}月)", r"(\d{1,2}月\d{1,2}日)", r"(\d{4}-\d{1,2}-\d{1,2})", r"(\d{1,2}/\d{1,2}/\d{4})"],
    "amount": [r"(\d+(?:\.\d+)?元)", r"(\d+(?:\.\d+)?万元)", r"(\d+(?:,\d{3})*(?:\.\d+)?元)", r"(人民币\s*\d+(?:,\d{3})*(?:\.\d+)?元)", r"(\$\s*\d+(?:,\d{3})*(?:\.\d+)?)"],
    "location": [rf"([^，,。\n]*{unit}[^，,。\n]*)" for unit in ("市", "省", "区")],
    "person": [r"法定代表人[：:]\s*([^，,。\n]+)", r"代表人[：:]\s*([^，,。\n]+)", r"联系人[：:]\s*([^，,。\n]+)", r"签字[：:]?\s*([^，,。\n]+)"],
}
#: Least and greatest length of a tag of a kind, where that is bounded.
TAG_LENGTHS = {"location": (2, 10)}
DATE_PATTERNS = [
    ("ymd", r"(\d{4})年(\d{1,2})月(\d{1,2})日"),
    ("dash", r"(\d{4})-(\d{1,2})-(\d{1,2})"),
    ("slash", r"(\d{4})/(\d{1,2})/(\d{1,2})"),
    ("dot", r"(\d{4})\.(\d{1,2})\.(\d{1,2})"),
    ("md", r"(\d{1,2})月(\d{1,2})日"),
]
#: Scores of the three axes and their weights; level thresholds of the second scheme.
SCORE_A = {"region": ({"MAIN": 4, "COVER": 3, "APPENDIX": 3, "TOC": 2, "SIGN": 2}, 1, 0.3), "nc_type": ({"CLAUSE_BODY": 4, "TITLE": 3, "PARTIES": 2}, 1, 0.3), "role": ({"CLAUSE": 4}, 1, 0.4)}
SCORE_B = {"role": ({"CLAUSE": 4}, 0, 0.4), "region": ({"MAIN": 2, "APPENDIX": 1}, 0, 0.2), "nc_type": ({"CLAUSE_BODY": 4, "TITLE": 1, None: 1}, 0, 0.4)}
LEVELS_B = [(3.5, "4"), (2.5, "3"), (1.5, "2")]
ALLOWED_NC_TYPES = {"COVER": ["TITLE", "PARTIES", None], "TOC": [None], "MAIN": ["TITLE", "CLAUSE_BODY", None], "APPENDIX": ["TITLE", "CLAUSE_BODY", None], "SIGN": ["PARTIES", "TITLE", None]}
FILE_TYPES = {".pdf": "pdf", ".docx": "docx", ".doc": "docx", ".txt": "txt", ".md": "markdown", ".html": "html", ".htm": "html"}

# Chunking weights; a mode overrides the defaults.
CHUNK_DEFAULTS = {
    "indent_jump": 16, "w_enum": 1.5, "w_indent_back": 1.6, "w_indent_forward": 0.4, "w_lead": 1.0, "w_heading": 0.8, "w_soft": 1.0,
    "w_sem_start": 1.0, "w_sem_cont": 0.8, "sem_margin_pos": 0.10, "sem_margin_neg": -0.06, "ema_alpha": 0.30, "short_len_bias": 8,
    "short_len_cont_bonus": 0.6, "bias_start": -0.8, "pen_SS": -0.6, "pen_CC": 0.1, "pen_SC": 0.0, "pen_CS": 0.0,
    "tie_margin": 0.25, "ce_delta_start": -0.05, "ce_delta_cont": 0.05,
}
CHUNK_MODES = {
    "contract": {"w_heading": 1.2, "w_indent_back": 1.8, "pen_CC": 0.15},
    "summary": {"w_heading": 1.0, "w_indent_back": 1.2, "w_enum": 1.6, "w_sem_start": 1.2, "w_sem_cont": 0.6, "sem_margin_neg": -0.04, "sem_margin_pos": 0.12, "pen_SS": -0.8},
    "single": {"w_heading": 0.6, "w_indent_back": 1.0, "w_enum": 1.2, "w_sem_start": 0.6, "w_sem_cont": 1.0, "sem_margin_neg": -0.08, "sem_margin_pos": 0.06, "pen_SS": -1.2, "pen_CC": 0.2, "short_len_cont_bonus": 0.8, "ema_alpha": 0.35},
}

# Rules for Latin-script text, used by the queries over the given tables.
NEUTRAL_REGIONS = [("TOC", ["table of contents", "===="]), ("COVER", ["license", "copyright"]), ("SIGN", ["signed", "@"]), ("APPENDIX", ["http", "www"])]
NEUTRAL_NC_TYPES = {"COVER": [("TITLE", ["license"])], "MAIN": [("TITLE", ["###", "title"]), ("CLAUSE_BODY", [" and ", " und ", " et ", " y "])], "APPENDIX": [("TITLE", ["http"])], "SIGN": [("PARTIES", ["@"])]}
NEUTRAL_ROLE_WORDS = ["the", "and", "of", "die", "und", "der", "le", "de", "et", "la", "que", "en"]
NEUTRAL_CLASSES = [("EN", [" the ", " and ", " of ", " that "]), ("DE", [" die ", " und ", " der ", " sch "]), ("FR", [" le ", " et ", " les ", " des "]), ("ES", [" la ", " que ", " los ", " por "])]
