"""The words that steer guarding, routing and claim checking of questions."""

from __future__ import annotations

# Terms that place a question inside the supported domain.
DOMAIN_TERMS = (
    "adc", "antibody drug conjugate", "抗体偶联药物", "抗体药物偶联物", "靶点", "抗体", "载荷", "payload", "linker", "连接子",
    "dar", "临床试验", "pubmed", "nct", "肿瘤", "癌", "her2", "trop2", "文献", "论文", "研究", "变化", "冲突", "来源", "记录",
)

# Requests for individual medical advice.
UNSAFE_PATTERNS = (
    "个体化剂量", "患者应该使用", "是否应该用", "替我诊断", "开处方", "调整用药", "personalized dose", "prescribe",
    "diagnose this patient", "患者应该停用", "患者应停用", "患者继续使用", "患者是否应该", "该不该停用", "personalized treatment",
)

# Requests about the future or about unpublished results.
FUTURE_PATTERNS = (
    "预测未来", "尚未公布", "未来一定", "2030年以后", "2035", "2040", "predict future", "not yet published", "目标价", "股价",
    "投资回报", "成功率", "预测",
)

# A missing source together with a wish to fill the value in.
NO_SOURCE_PATTERNS = ("没有来源时", "没有来源", "缺少来源时", "无来源时", "without a source", "without sources", "no source")
FILL_IN_ACTIONS = ("补全", "补充", "猜一个", "填一个", "给出精确", "fill in", "complete", "guess", "make up")

# A personal context together with a wish for action.
PERSONAL_CONTEXT = (
    "患者", "病人", "个人", "本人", "我患", "我得了", "我被诊断", "我的病", "我的肿瘤", "我的癌", "我正在用", "我正在使用",
    "我应该", "我该", "我能否", "我能不能", "我可以", "我适合", "适合我", "给我用", "给我推荐", "给我开", "我妈妈", "我爸爸",
    "我的母亲", "我的父亲", "我的孩子", "我的妻子", "我的丈夫",
)
PERSONAL_ACTION = (
    "停用", "继续使用", "换药", "调整用药", "是否应该", "该不该", "应该使用", "应该用", "能不能用", "能否用", "可以用", "适合",
    "推荐", "选择哪种", "用哪种", "哪种 adc", "什么剂量", "多少剂量", "剂量是多少", "用多少", "怎么用药", "如何用药", "调整剂量",
    "剂量方案",
)
PERSONAL_CONTEXT_REGEX = (
    r"\b(?:i (?:have|was diagnosed|am taking|am on)|my (?:patient|cancer|tumou?r|mother|father|child|wife|husband)|"
    r"this patient|for me|(?:should|can|could) i)\b"
)
PERSONAL_ACTION_REGEX = (
    r"\b(?:(?:should|can|could) (?:i|we|this patient)|which (?:adc|drug|treatment)|what (?:dose|dosage)|how much|"
    r"recommend(?:ation|ed)?|suitable|appropriate|prescribe|(?:adjust|increase|reduce) (?:the |my )?(?:dose|dosage)|"
    r"(?:start|stop|switch|continue) (?:taking|using|treatment))\b"
)

# Intents whose evidence must name the topic itself.
TOPIC_ANCHORS = (
    ("旁观者效应", "bystander effect", "bystander"),
    ("耐药逆转", "resistance reversal", "overcoming resistance"),
    ("释放速率", "release rate", "release kinetics"),
    ("最大耐受剂量", "maximum tolerated dose", "mtd"),
    ("客观缓解率", "objective response rate", "orr"),
    ("体内半衰期", "in vivo half-life", "half-life"),
)

# Words of the four question intents.
COMPARISON_MARKERS = ("比较", "对比", "区别", "差异", "不同", "异同", " versus ", " vs ")
CHANGE_MARKERS = ("最近", "近一", "变化", "变更", "更新", "新增", "过去", "采集失败", "来源缺失", "记录缺失", "变化事件", "冲突")
TRIAL_MARKERS = ("临床试验", "试验", "注册号", "招募", "主要终点", "入组", "nct")
LITERATURE_MARKERS = (
    "pubmed", "pmid", "文献", "论文", "摘要", "机制", "耐药", "研究结论", "疗效", "安全性", "半衰期", "活性", "转运", "释放",
    "研究", "提及", "综述", "提到", "客观缓解率", "最大耐受剂量",
)
TARGETS = ("HER2", "TROP2")

# Words that ask for an entity field.
FIELD_MARKERS = (
    ("adc.payload_class", ("payload class", "载荷类型", "载荷类别", "作用机制类型")),
    ("adc.payload_name", ("payload name", "payload", "载荷名称", "载荷")),
    ("adc.linker_type", ("linker type", "type of linker", "linker kind", "哪一类连接子", "哪类连接子", "连接子类型", "linker类型")),
    ("adc.linker_name", ("linker name", "连接子名称", "linker", "连接子")),
    ("adc.development_status", ("研发状态", "开发状态", "获批状态", "development status")),
    ("adc.company", ("开发企业", "企业", "公司", "company", "sponsor")),
    ("adc.antibody", ("抗体", "antibody")),
    ("adc.target", ("靶点", "target")),
    ("adc.dar", ("药物抗体比", "dar")),
    ("adc.indication", ("适应证", "适应症", "indication")),
)
# Fields that are asked for but not held.
UNSUPPORTED_FIELD_MARKERS = (
    ("adc.antibody_subtype", ("抗体亚型", "抗体同种型", "antibody subtype", "antibody isotype")),
    ("adc.glycosylation_sites", ("糖基化位点", "glycosylation site")),
    ("adc.linker_cleavage_site", ("断裂位点", "切割位点", "cleavage site")),
    ("adc.intellectual_property", ("知识产权", "专利归属", "intellectual property", "patent ownership")),
)
# A field on the left is dropped when the one in the middle is asked for, unless one of the words on the right occurs.
FIELD_OVERRIDES = (
    ("adc.antibody", "adc.antibody_subtype", ("抗体名称", "抗体名", "antibody name")),
    ("adc.linker_name", "adc.linker_cleavage_site", ("连接子名称", "linker name")),
    ("adc.payload_name", "adc.payload_class", ("payload name", "载荷名称")),
    ("adc.linker_name", "adc.linker_type", ("linker name", "连接子名称")),
)
PROFILE_DEFAULTS = ("adc.target", "adc.payload_name", "adc.payload_class", "adc.dar", "adc.development_status")

# Words that ask for a trial field.
TRIAL_FIELD_MARKERS = (
    ("trial.nct_id", ("nct", "注册号")),
    ("trial.overall_status", ("状态", "招募", "撤回", "暂停", "status")),
    ("trial.phases", ("阶段", "几期", "期试验", "phase")),
    ("trial.conditions", ("疾病", "癌种", "条件", "condition")),
    ("trial.interventions", ("干预", "用药", "intervention")),
    ("trial.primary_outcomes", ("主要终点", "终点", "outcome", "endpoint")),
    ("trial.enrollment", ("入组", "人数", "enrollment")),
    ("trial.start_date", ("开始日期", "启动日期", "start date")),
    ("trial.completion_date", ("完成日期", "completion date")),
)
TRIAL_DEFAULTS = ("trial.nct_id", "trial.overall_status", "trial.phases")
TRIAL_LABELS = (
    ("trial.nct_id", "注册号", "nct_id"),
    ("trial.overall_status", "试验状态", "overall_status"),
    ("trial.phases", "试验阶段", "phases"),
    ("trial.conditions", "疾病/条件", "conditions"),
    ("trial.interventions", "干预", "interventions"),
    ("trial.primary_outcomes", "主要终点", "primary_outcomes"),
    ("trial.enrollment", "入组人数", "enrollment"),
    ("trial.start_date", "开始日期", "start_date"),
    ("trial.completion_date", "完成日期", "completion_date"),
)
PHASE_MARKERS = (("iii期", "PHASE3"), ("3期", "PHASE3"), ("ii期", "PHASE2"), ("2期", "PHASE2"), ("i期", "PHASE1"), ("1期", "PHASE1"))

# Time windows of change questions.
MONTH_MARKERS = ("30天", "三十天", "一个月", "近月")
DAY_MARKERS = ("1天", "一天", "24小时", "今天", "今日")

# Source types and topics of literature questions.
SOURCE_TYPE_MARKERS = (
    ("clinical_trial", ("临床试验", "注册号", "nct", "期试验", "招募状态", "已撤回")),
    ("pubmed", ("pubmed", "哪篇文献", "文章", "meta-analysis")),
    ("adc_profile", ("dar", "药物抗体比", "linker", "连接子", "研发状态", "开发企业", "公司")),
)
TOPIC_MARKERS = (
    ("mechanism", ("机制", "mechanism", "内化", "旁观者")),
    ("efficacy", ("疗效", "efficacy", "缓解率", "生存")),
    ("safety", ("安全", "safety", "毒性", "不良事件")),
)

# Texts of gaps by reason.
GAP_DETAILS = (
    ("conflicted", "存在未解决的来源冲突，系统不选择单一值。"),
    ("validation_failed", "结构化值或字段证据映射未通过校验。"),
    ("unsupported_requested_field", "当前结构化模式没有该属性的字段定义，系统不会用相近字段代答。"),
    ("missing_direct_evidence", "当前事实层没有该字段的直接证据。"),
    ("no_matching_record", "当前记录中没有匹配项。"),
)

# Claim checking: headings that are no claims, words that carry no evidence, connectors between them.
HEADINGS = ("答案", "回答", "依据", "结论", "answer", "evidence")
SUPPORT_NOISE = ("adc", "answer", "evidence", "pubmed", "结论", "文献", "研究", "结果", "证据", "证据摘录", "摘录", "根据", "报道")
CONNECTORS = (
    "的数据表明", "的研究显示", "研究表明", "研究显示", "证据显示", "证据表明", "可能", "提示", "发现", "显示", "表明", "认为",
    "以及", "其中", "用于", "关于", "相关", "分别", "当前", "已经", "可以", "为", "是", "的", "与", "及", "和", "在", "中",
)

# Extraction: words added to the query terms, and the line prefixes that answer a field.
QUERY_CONCEPTS = (
    ("靶点", ("target", "antigen")), ("载荷", ("payload", "warhead")), ("连接子", ("linker",)), ("药物抗体比", ("dar",)),
    ("dar", ("dar",)), ("研发状态", ("development", "status")), ("阶段", ("phase",)), ("状态", ("status",)),
    ("主要终点", ("primary", "outcomes", "endpoint")), ("安全性", ("safety", "toxicity")),
    ("疗效", ("efficacy", "response", "survival")), ("机制", ("mechanism", "internalized", "release", "activity")),
    ("细胞内转运", ("internalized", "trafficking", "lysosome")), ("内化", ("internalized", "internalization")),
    ("释放", ("release", "released")), ("临床前", ("preclinical",)), ("抗肿瘤", ("antitumor", "activity")),
)
PROFILE_PREFIXES = (
    ("靶点 / target:", ("靶点", "target"), ()),
    ("载荷类型 / payload class:", ("载荷类型", "payload class", "payload type"), ()),
    ("载荷 / payload:", ("载荷名称", "payload name"), ()),
    ("药物抗体比 / dar:", ("dar", "药物抗体比"), ()),
    ("连接子类型 / linker type:", ("连接子类型", "linker type", "linker类型"), ()),
    ("连接子 / linker:", ("连接子名称", "linker name"), ()),
    ("研发状态 / development status:", ("研发状态", "development status"), ()),
    ("企业 / company:", ("企业", "公司", "company"), ()),
    ("连接子 / linker:", ("linker", "连接子"), ("连接子类型", "linker type", "linker类型", "连接子名称", "linker name")),
    ("载荷 / payload:", ("载荷", "payload"), ("载荷类型", "payload class", "payload type", "载荷名称", "payload name")),
)
TRIAL_PREFIXES = (
    ("clinical trial:", ()),
    ("brief title:", ()),
    ("recruitment status:", ("状态", "招募", "撤回")),
    ("phase:", ("期", "phase", "阶段")),
    ("primary outcomes:", ("终点", "outcome", "endpoint")),
)
