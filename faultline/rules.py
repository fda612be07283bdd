"""Fixed values of the method: weights, thresholds, unit scales, categories and text rules.

These decide the results, so they are stated once, in plain text, and applied as rule tables.
"""

# ---- fragility score (fixed values)
METRICS = {  # metric: (dimension, +1 higher is worse / -1 lower is worse)
    "debt_ratio": ("leverage", 1), "current_ratio": ("liquidity", -1), "quick_ratio": ("liquidity", -1),
    "cash_ratio": ("liquidity", -1), "ocf_to_revenue": ("cash", -1), "net_margin": ("profit", -1),
    "gross_margin": ("profit", -1), "revenue_growth": ("profit", -1), "excess_ret_60d": ("market", -1),
    "max_drawdown_60d": ("market", -1), "vol_20d": ("market", 1),
}
ABSOLUTE = {"guarantee_to_equity": ("contingent", 1.0)}
WEIGHTS = {"leverage": 0.2, "liquidity": 0.2, "cash": 0.15, "profit": 0.15, "market": 0.15, "contingent": 0.15}
WEIGHT_PROFILES = {
    "current": dict(WEIGHTS),
    "liquidity": {"leverage": 0.20, "liquidity": 0.30, "cash": 0.15, "profit": 0.10, "market": 0.10, "contingent": 0.15},
    "profit": {"leverage": 0.20, "liquidity": 0.15, "cash": 0.15, "profit": 0.25, "market": 0.10, "contingent": 0.15},
    "market": {"leverage": 0.15, "liquidity": 0.15, "cash": 0.15, "profit": 0.10, "market": 0.30, "contingent": 0.15},
}
WEAK, MEDIUM = 60, 40
EXTREME, EXTREME_DIMS = 90, ("leverage", "liquidity")
DEBT_RED_LINE, GUARANTEE_RED_LINE = 0.85, 1.0
EVENT_TYPES = ("credit_event", "supply_disruption", "share_pledge", "credit_exposure")
SENSITIVITY_THRESHOLDS = (55, 60, 65)
STRESS_TIER_WEIGHT = {"weak": 1.0, "medium": 0.5, "strong": 0.2}

# ---- validity (fixed values): months a relation or signal stays in force when no end is stated
DEFAULT_MONTHS = {"guarantee_limit": 12, "guarantee_provided": 36, "guarantee_overdue": 36, "related_estimate": 12,
                  "project": 12, "credit_event": 24, "share_pledge": 12, "maintenance": 3}

# ---- units (fixed values): scale to 10,000 yuan
TO_WAN = {"元": 1e-4, "人民币元": 1e-4, "千元": 0.1, "万元": 1.0, "人民币万元": 1.0, "百万元": 100.0, "亿元": 1e4, "人民币亿元": 1e4}
VOLUME_UNITS = ("吨", "万吨", "千吨", "亿吨", "立方米", "万立方米", "亿立方米", "千瓦时", "万千瓦时", "亿千瓦时", "件", "台", "辆", "艘")
FOREIGN_UNITS = ("美元", "万美元", "亿美元", "欧元", "万欧元", "港元", "万港元")

# ---- relations (fixed values): trade category -> (edge type, issuer is the supplier)
TRADE_CATEGORIES = {
    "purchase_goods": ("supply", False), "sell_goods": ("supply", True), "receive_services": ("service", False),
    "provide_services": ("service", True), "lease_in": ("lease", False), "lease_out": ("lease", True),
    "financial_services": ("finance", False), "other": ("other", True),
}
TRADE_EDGES = ("supply", "service", "lease")
SUBSIDIARY = ("wholly_owned_subsidiary", "controlled_subsidiary")
IN_ISSUER_GROUP = ("parent_or_controlling_shareholder", "sister_company", "wholly_owned_subsidiary", "controlled_subsidiary")
SELF_NAMES = ("本公司", "公司", "上市公司", "本集团")
SCOPE_SUFFIXES = (  # longest first
    ("及其下属子公司", "self_and_subsidiaries"), ("及其控制的企业", "self_and_subsidiaries"),
    ("及下属子公司", "self_and_subsidiaries"), ("及其子公司", "self_and_subsidiaries"), ("及子分公司", "self_and_subsidiaries"),
    ("及下属企业", "self_and_subsidiaries"), ("及子公司", "self_and_subsidiaries"), ("其他子公司", "subsidiaries"),
    ("下属子公司", "subsidiaries"), ("之子分公司", "subsidiaries"), ("之子公司", "subsidiaries"), ("的子公司", "subsidiaries"),
    ("之联营企业", "associates"), ("之合营企业", "associates"),
)

# ---- propagation (fixed values)
MAX_HOPS, MATERIALITY = 3, 0.01
LEVELS = ("low", "medium", "high")
SUPPLY_SIGNALS = ("supply_disruption", "capacity_reduction")
CREDIT_SIGNALS = ("credit_event", "credit_exposure", "share_pledge")
SEVERITY_WEIGHT = {"high": 3, "medium": 2, "low": 1}
#: Weight of an evidence grade in the strength of a supply flow.
GRADE_WEIGHT = {"A": 1.0, "B": 0.7, "C": 0.4}
REACH_TIER_WEIGHT = {"weak": 1.0, "medium": 0.5, "strong": 0.0}
OPAQUE_HIGH, OPAQUE_MEDIUM = 0.5, 0.1

# ---- credit events in announcement titles (fixed patterns, first match wins)
CREDIT_EXCLUDE = "解除|撤销|解冻|终止|申请撤销|摘帽|完成|结束|补充更正|更正|英文|摘要|说明会|问询|回复|法律意见|核查意见"
CREDIT_RULES = (
    ("guarantee_default", "逾期担保|担保.{0,12}(逾期|代偿)|承担.{0,6}(连带)?(保证|担保)责任"),
    ("debt_default", "(借款|贷款|债务|票据|债券|融资|商票).{0,10}(逾期|违约|未能.{0,4}(兑付|偿还|清偿))|未按期(兑付|偿还)|债务违约"),
    ("freeze", "(股份|股权|资产|账户|银行账户).{0,10}(司法冻结|被冻结|轮候冻结|司法拍卖|司法划转)"),
    ("st", "退市风险警示|其他风险警示|实施.{0,4}风险警示"),
    ("audit", "非标准(无保留)?(审计)?意见|保留意见|无法表示意见|否定意见"),
    ("rating", "评级.{0,8}(下调|调低|下降)|(下调|调低).{0,8}评级|负面观察|展望.{0,4}负面"),
    ("restructuring", "破产重整|预重整|破产清算"),
)
HEDGE, HEDGE_FX, HEDGE_COMMODITY, HEDGE_POLICY = ("套期保值|套保|衍生品", "外汇|汇率|远期结售汇", "商品|期货|大宗", "制度|办法|准则|细则")
SPECIFIC_STEEL = ("P_FLAT", "P_LONG", "P_SPECIAL", "P_PIPE")
AMOUNT_TYPE_RANK = {"上年实际发生": 3, "采购额": 3, "销售额": 3, "期末余额": 2, "销量": 2, "预计额度（上限）": 1}
PLANNED_CAP, ANONYMOUS = "预计额度（上限）", "N"

# ---- studies (fixed values)
LIFT_BAR, P_BAR, AUC_BAR, LOSS_SHARE = 1.5, 0.05, 0.60, 0.05
COLLAPSE_DAYS, CREDIT_EVENT_DAYS, SHOCK_GAP, JUMP = 90, 365, 10, 0.11
NONRECURRING_SHARE, CASH_CONTENT = 0.30, 0.50
ANNUALIZE = {"0331": 4.0, "0630": 2.0, "0930": 4.0 / 3.0, "1231": 1.0}
PRICE_SHOCK_ROWS, PRICE_SHOCK = 20, 0.10

# ---- carbon (fixed values): tonnes of CO2 per tonne by route, share of the border levy by year
CARBON_INTENSITY = {"BF-BOF": 2.34, "EAF": 0.69, "DRI-EAF": 1.47}
BORDER_FACTOR = {2026: 0.025, 2027: 0.05, 2028: 0.10, 2029: 0.225, 2030: 0.485, 2031: 0.61, 2032: 0.735, 2033: 0.86, 2034: 1.0}

# ---- framework agreements (fixed patterns)
AGREEMENT_EXPLICIT = (r"(?:有效期|期限)[^。；]{0,12}?自\s*(\d{4})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日"
                      r"[^。；]{0,12}?至\s*(\d{4})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日")
AGREEMENT_YEARS = r"(\d{4})\s*(?:年度?)?\s*(?:至|-|–|—|~)\s*(\d{4})\s*年度?[^。；]{0,12}(?:关联交易|协议)"

# ---- announcement titles (fixed patterns, first match wins)
TITLE_TASKS = (
    ("related_party", "日常关[联连]交易|日常经营相关的关[联连]交易|持续关[联连]交易|关[联连]交易(?:的)?(?:预计|框架|(?:补充)?协议|额度)"),
    ("guarantee", "担保"),
    ("capacity", "产能|投产|技术改造|技改|建设项目|检修|停产|项目.{0,6}(延期|终止|暂停)|高炉|转炉|电炉"),
    ("pledge", "质押"),
)
TITLE_EXCLUDE = ("意见|核查|法律|独立董事|监事会|保荐|英文|摘要|问询|回复|更正|补充更正|取消|说明会|"
                 "会议资料|决议|通知|制度|章程|激励|H股|海外监管|债券|跟踪评级|评级报告")
PAGE_TASKS = (
    ("related_party", "日常关[联连]交易|日常经营相关的关[联连]交易|持续关[联连]交易"),
    ("pledge", "股份质押|质押(?:的)?(?:进展)?公告|解除质押|质押展期|补充质押"),
    ("guarantee", "担保"),
    ("capacity", "停产|检修|产能|投产|技术改造|技改|建设项目|高炉|转炉|电炉|项目"),
)
ACCOUNTING, ACCOUNTING_DAYS, HEDGE_MONTHS = "会计政策变更|会计估计变更|前期会计差错|差错更正|追溯调整", 365, 15

# ---- products (fixed values): id, name, words; the first match wins
NOT_PRODUCT = "其他|补充|合计|租赁|劳务|服务|贸易|物流|利息|内部抵消|抵销|分部间"
PRODUCTS = (
    ("P_IRON_ORE", "铁矿石", "铁矿|矿石|精矿|球团|矿粉"),
    ("P_COKING_COAL", "焦煤", "焦煤|炼焦煤|原煤|煤炭|洗精煤"),
    ("P_COKE", "焦炭", "焦炭|焦化"),
    ("P_SCRAP", "废钢", "废钢"),
    ("P_ALLOY", "铁合金与辅料", "铁合金|硅锰|硅铁|锰|钒|钛|耐火|耐材|石灰"),
    ("P_SPECIAL", "特钢与不锈钢", "特钢|特殊钢|不锈|合金钢|轴承钢|齿轮钢|模具钢|工具钢|弹簧钢|高温合金|精密合金|钛合金"),
    ("P_PIPE", "钢管", "钢管|管材|无缝|焊管|铸管|管道|管件"),
    ("P_FLAT", "板材", "板材|板卷|板带|钢板|热轧|冷轧|中厚板|宽厚板|热带|带钢|镀锌|涂层|硅钢|卷板|薄板|中板|厚板|汽车板"),
    ("P_LONG", "长材（建筑用钢）", "长材|螺纹|线材|高线|棒材|型钢|型材|建材|盘条|钢筋|圆钢|钢轨|H型"),
    ("P_STEEL", "钢材（未细分品种）", "钢材|坯材|钢铁制造|钢铁业|钢铁行业|钢压延|黑色金属|炼钢轧钢"),
    ("P_SEMI", "钢坯与生铁", "钢坯|方坯|板坯|生铁|铁水|钢锭"),
)

# ---- questions (fixed patterns, first match wins)
ADVICE = "买入|卖出|抄底|荐股|推荐.{0,6}股|该不该买|买哪|哪只.{0,6}股|赚钱|股价|走势|涨停|目标价|仓位|加仓|减仓|多买|投资建议"
DOMAIN = "钢|铁|焦|矿|煤|产业链|行业|企业|公司|厂|风险|预警|承压|担保|关联|公告|出口|关税|系统|你们|结论|验证|关注"
INTENTS = (
    ("document", "公告|上传|这份|文件|pdf|PDF"),
    ("trust", "准不准|准确|可信|靠谱|验证|检验|回测|证据等级"),
    ("export", "出口|关税|反倾销|退税|海外|境外"),
    ("spread", "传给|传到谁|传导到哪|影响谁|影响哪些|波及|连累|拖累|殃及|出事.*谁|出问题.*谁|暴雷.*谁"),
    ("exposure", "传到|来自|被.*影响|受.*影响|谁会影响|风险来源|哪些企业的风险|上游.*风险|被谁"),
    ("ranking", "最弱|最差|最危险|风险最大|排名|排行|排第|第几|哪些.*(弱|危险)|前几|前十"),
    ("today", "今天|今日|当前|现在|最近|最该|关注什么|预警"),
)
COMPANY_INTENTS = ("spread", "exposure")
SPREAD_VERBS, PRICE_WORDS = "传给|影响谁|影响哪些|波及|连累|拖累|殃及", "涨|跌|价格|价"
MOVE = r"(涨|上涨|上升|提高|增加|跌|下跌|下降|降低|减少|下调|上调)?\s*(\d+(?:\.\d+)?)\s*(%|％|个百分点|成)"
DOWN = "跌|下跌|下降|降低|减少|下调"


# Wording that decides how capacity announcements are cleaned.
MONETARY_UNIT = r"^(人民币|美元|港元|欧元|日元)?(元|千元|万元|百万元|千万元|亿元|万美元|亿美元|美元)$"
INVESTMENT_UNIT_SCALE = {"元": 1, "万元": 10_000, "亿元": 100_000_000, "美元": 1, "万美元": 10_000, "亿美元": 100_000_000}
NON_PROJECT_CAPITAL = "注册资本|注册资金|授权资本|融资|担保|授信|额度|借款|贷款|募集资金净额|募集资金总额|发行费用|资产总[计额]|净资产|总资产"
FRAMEWORK_PLAN = r"投资框架计划|固定资产投资(年中)?计划|年度投资计划|投资计划(调整)?$"
TEMPORARY_LOSS = (r"(停产|停炉|停机|检修|休风|焖炉|限产|减产).{0,30}?\d+(\.\d+)?\s*(天|日|个月)|\d+(\.\d+)?\s*(天|日|个月).{0,20}?(停产|停炉|检修)"
                  r"|(减少|影响|损失|降低).{0,15}?(产量|铁水量|钢产量)|复产|恢复生产")
PERMANENT_RETIREMENT = "淘汰|拆除|去功能化|退出|关停|永久"
EXPLICIT_RETIREMENT = "淘汰|退出|关停|拆除|停产|去功能化"
HYPOTHETICAL_OUTPUT = "完全达产后|整体建成投产后|项目建成后|建成投产后|预计可年产|将形成年产|计划新增年产"
FORMAL_CAPACITY = "生产规模|新增产能|年新增|设计产能"
FORMAL_SCALE = r"生产规模(为|：|:)?.{0,40}?\d+(\.\d+)?万吨/年"
FORMAL_AGGREGATE = r"(生产规模|新增产能|设计产能)(?:为|：|:)?([^，。；;\d]{1,30}?)(\d+(?:,\d{3})*(?:\.\d+)?)\s*(万吨/年|万吨|吨/年)"
EQUIPMENT_SPEC_UNITS = ("m³/座", "m3/座", "m³", "m3", "立方米", "立方米/座", "㎡/台", "㎡", "平方米", "平方米/台", "t/座", "t", "吨", "吨/座",
                        "mm/条", "毫米/条", "mm", "毫米")
EQUIPMENT_COUNT_UNITS = ("台", "座", "条", "套")
TECHNICAL_UPGRADE = ("成熟技术移植", "技术移植", "工艺改造", "系统改造", "升级改造", "大修")
ACTUAL_COMMISSIONING = "正式投产|投入生产|建成投运|全线投产|顺利出铁|顺利出焦|成功下线"
NON_COMMISSIONING = "验收|预计|计划|公告|董事会"
ADVERSE_EVENTS = ("termination", "suspension", "delay")


# Wording of printed tables in annual reports and announcements.
REGION_TITLE = "^(分地区|主营业务分地区情况)"
REGION_FOREIGN = "境外|国外|海外|出口|国际|外销|亚洲|欧洲|美洲|非洲|大洋洲|中东|东南亚|港澳台|其他国家"
REGION_DOMESTIC = "中国大陆|境内|国内|内销|中国境内"
REGION_WORD = "华东|华南|华北|华中|西南|西北|东北|东部|西部|南部|北部|中部|省|市|区域|地区"
REGION_STOP = r"分销售模式|分行业|分产品|说明|占公司营业收入|产销量|^\s*\(?\d\)|^（\d）"
REGION_NOT_A_ROW = "营业收入|营业成本|毛利率|分地区|合计|小计|单位"
STATED_UNIT = r"单位[:：]\s*(?:人民币)?\s*(百万元|千元|万元|亿元|元)"
ORE_TITLE = "铁矿石供应情况"
ORE_ROWS = {"self": "自供", "domestic": "国内采购", "import": "国外进口", "total": "合计"}
PARTY_TABLES = (("应收账款", "receivable"), ("预付", "prepayment"), ("应付账款", "payable"), ("供应商", "supplier"), ("客户", "customer"))
PARTY_TITLE = "前五[名大](客户|供应商)|应收账款.{0,10}前五名|预付.{0,10}前五名|应付账款.{0,10}前五名"
ANONYMOUS_PARTY = r"^(单位|客户|供应商|债务人|公司)?\s*[一二三四五六七八九十0-9A-Za-z]{1,2}\s*$|^第[一二三四五]名$|^[A-ER]$"
PARTY_COLUMN_WORDS = "单位|余额|金额|比例|占比|序号|名称|性质|关联|账龄|坏账|年末|月末"
PARTY_ROW_WORDS = "是|否|关联方|第三方|货款|工程款|往来款|借款"


# Relationship that an entity table implies, by the scope of the counterparty's name.
SCOPE_OF_PARENT = {"self": "parent_or_controlling_shareholder", "self_and_subsidiaries": "parent_or_controlling_shareholder", "subsidiaries": "sister_company",
                   "associates": "other_related_party"}
# Wording of guarantees, pledges and project agreements.
CUMULATIVE_HEADING = "[一二三四五六七八九十]+、(公司)?累计对外担保"
DATE_ONLY = r"^\s*\d{4}\s*([-/.]|年)\s*\d{1,2}\s*([-/.]|月)\s*\d{1,2}\s*日?\s*$"
RELEASE_BOOLEANS = ("is_restricted_share", "is_supplementary_pledge")
PROJECT_AGREEMENT = "(项目合资协议|项目投资协议|项目建设协议)$"
AGREEMENT_CAPACITY = r"(年产|产能|生产规模).{0,30}\d+(\.\d+)?万?吨"
