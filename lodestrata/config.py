"""Limits, word lists and registries that decide results. Algorithms elsewhere take them as parameters."""

# Retrieval limits and reciprocal-rank constants.
RRF_K, WIKI_RRF_K = 60, 70
TOP_K, WIKI_PAGES, CITATIONS_PER_PAGE, WIKI_REFS = 20, 8, 12, 3
FTS_TERMS, POOL_MIN, POOL_FACTOR = 12, 80, 8
CANDIDATES, FINAL_EVIDENCE = 18, 6
GRAPH_TOP, GRAPH_CAP, SEED_MIN = 24, 0.035, 12
SEARCH_LIMIT, REWRITES, RERANKED = 10, 2, 12
VARIANTS, SIMPLE_VARIANTS = 4, 2
BM25_K1, BM25_B, IDF_FLOOR = 1.2, 0.75, 1e-6

# Chunking, wiki and graph limits.
TARGET_TOKENS, MAX_TOKENS, OVERLAP_TOKENS = 600, 800, 100
WIKI_SECTIONS, SECTION_EVIDENCE, PAGE_WINDOW, SHORT_TEXT, LONG_TEXT = 30, 12, 10, 360, 900
GRAPH_PAGES, PAGE_ENTITIES, RULE_ENTITIES, STRONG_ENTITIES, NEXT_ENTITIES = 80, 24, 18, 8, 3
JUDGE_THRESHOLD, HISTORY_TURNS, MEMORY_LIMIT = 0.65, 6, 20
UPLOAD_MB = 100
SUFFIXES = ("md", "markdown", "txt", "docx", "pdf")
PARSE_MODES = ("auto", "text", "ocr", "vlm")
EDGE, EDGE_CHARS, EDGE_PAGES, EDGE_SHARE = 0.09, 120, 3, 0.35

# Domain -> (keywords in a question, keywords in a title).
DOMAINS = {
    "simulink": (("simulink", "model", "block", "signal", "subsystem", "simulation", "仿真", "模型", "模块", "信号", "子系统"), ("simulink",)),
    "stateflow": (("stateflow", "chart", "state", "transition", "event", "truth table", "flow chart", "状态机", "状态图", "状态", "转移", "转换", "事件", "真值表"), ("stateflow",)),
    "autosar": (("autosar", "arxml", "composition", "component", "runnable", "rte", "port", "software component", "软件组件", "组合", "端口"), ("autosar", "arxml")),
    "solver": (("solver", "fixed-step", "variable-step", "step size", "ode", "求解器", "固定步长", "可变步长", "步长"), ("solver", "求解器")),
    "testing": (("mil", "sil", "pil", "hil", "test", "verify", "verification", "coverage", "requirements", "测试", "验证", "覆盖率", "需求"), ("mil", "sil", "pil", "test", "verify", "测试", "验证")),
    "codegen": (("code generation", "coder", "embedded coder", "c code", "生成代码", "代码生成", "嵌入式", "embedded"), ("coder", "code generation", "embedded")),
}

# Triggers in a question and the words they add to a variant.
EXPANSIONS = (
    (("stateflow", "状态机", "状态流"), "Stateflow chart finite state machine state transition event action Simulink"),
    (("chart", "图表", "状态图"), "Stateflow chart state transition diagram"),
    (("transition", "转移", "转换"), "transition state event condition action Stateflow"),
    (("event", "事件"), "event broadcast chart execution Stateflow"),
    (("truth table", "真值表"), "truth table decision logic Stateflow"),
    (("autosar", "arxml"), "AUTOSAR component composition ARXML Simulink"),
    (("simulink", "仿真"), "Simulink model simulation block signal subsystem"),
    (("求解器", "solver", "步长"), "solver fixed-step variable-step simulation Simulink"),
)

# Cues of question roles and of relations in evidence.
RELATION_CUES = ("relationship", "relation", "relate", "connect", "integration", "integrate", "mapping", "map", "import", "export", "interface", "interact", "between", "关系", "关联", "联系", "连接", "集成", "映射", "导入", "导出", "接口", "交互", "之间")
COMPARISON_CUES = ("compare", "difference", "versus", "vs", "区别", "对比", "比较", "差异")
PROCEDURE_CUES = ("how", "steps", "workflow", "process", "怎么", "如何", "步骤", "流程")
DEFINITION_CUES = ("what is", "define", "definition", "是什么", "定义")
RELATION_EVIDENCE = ("relationship", "related", "relate", "connect", "connection", "integration", "integrate", "mapping", "mapped", "map", "import", "export", "interface", "interact", "composition", "component", "arxml", "runnable", "port", "signal", "subsystem", "model reference", "关系", "关联", "联系", "连接", "集成", "映射", "导入", "导出", "接口", "交互", "组成", "组件", "端口", "信号")
SIMPLE_CUES = ("关系", "是什么", "定义", "relationship", "what is")
COMPLEX_CUES = ("为什么", "区别", "对比", "如何", "步骤", "流程", "原因", "怎么", "compare", "difference", "why", "how", "steps", "workflow")
KEY_TERMS = ("autosar", "simulink", "stateflow", "solver", "fixed-step", "variable-step", "arxml")
DEFINITION_BOOST_CUES = ("是什么", "定义", "关系", "what is", "relationship")
SKIP_DENSE_TERMS = ("autosar", "arxml", "stateflow", "simulink", "solver", "fixed-step", "variable-step", "求解器", "固定步长", "可变步长", "状态机")
SOLVER_TERMS = ("solver", "fixed-step", "variable-step", "求解器", "固定步长", "可变步长")
CODEGEN_TERMS = ("code generation", "代码生成", "生成代码", "coder", "embedded coder")

# Words that a question may hold without asking for them, and spellings that count as covered.
GENERIC_TERMS = ("what", "how", "does", "can", "could", "should", "would", "is", "are", "the", "this", "that", "with", "from", "into", "directly", "relationship", "between", "use", "uses", "case", "cases", "generate", "generation", "model", "models", "system", "knowledge", "base", "support", "supports", "and", "or", "to", "in", "on", "of", "a", "an", "for", "by", "as", "simulink", "matlab")
ACTION_TERMS = ("generate", "generation", "import", "export", "map", "maps", "mapping", "convert", "conversion", "simulate", "simulation", "support", "supports", "directly", "create", "creates", "open", "run")
ALIASES = {
    "ros2": ("ros2", "ros 2", "ros_2", "ros-2"),
    "ros": ("ros", "ros2", "ros 2"),
    "node": ("node", "nodes"),
    "nodes": ("node", "nodes"),
    "arxml": ("arxml", "xml"),
    "autosar": ("autosar",),
    "stateflow": ("stateflow",),
    "simulink": ("simulink",),
    "fixed-step": ("fixed-step", "fixed step", "fixedstep"),
    "variable-step": ("variable-step", "variable step", "variablestep"),
}

# Snippets, prompt evidence and generation budgets by role.
SNIPPET_CHARS, SNIPPET_UNITS, SNIPPET_RANKED, SNIPPET_MIN, SNIPPET_WINDOW = 460, 3, 6, 12, 220
UNIT_MARKS = (":", "：", "->", "→", "maps", "mapping", "import", "export")
ROLE_LIMITS = {"definition": 3, "relationship": 4, "comparison": 4, "procedure": 5, "general": 4}
ROLE_BUDGETS = {"definition": 150, "relationship": 340, "comparison": 380, "procedure": 440, "general": 320}

# Intents and the phrases that select them, in order of precedence after greetings.
GREETINGS = ("你好", "您好", "在吗", "在不在", "有人吗", "哈喽", "哈啰", "嗨", "早上好", "晚上好", "hello", "hi", "hey", "yo")
PARTICLES = "啊呀呢嘛吗啦了哦噢哟哈喔欸诶呗吧喽"
DOMAIN_TERMS = ("simulink", "autosar", "matlab", "stateflow", "mil", "sil", "hil", "arxml", "求解器", "仿真", "代码生成", "模型", "测试", "状态机", "模块", "组件", "端口", "信号", "总线", "步长", "固定步长", "可变步长", "嵌入式", "标定", "需求")
INTENTS = (
    ("identity", ("你是谁", "你是什么", "介绍一下你", "你叫啥")),
    ("capabilities", ("你有什么功能", "你可以做什么", "你能做什么", "你会做什么", "能干什么", "功能介绍", "怎么用", "使用方法", "你能帮我什么", "可以帮我什么")),
    ("upload_help", ("怎么上传", "上传文档", "导入文档", "知识库怎么构建", "怎么入库")),
    ("citation_help", ("引用怎么看", "证据怎么看", "e:n", "原文在哪", "pdf原页")),
    ("judge_help", ("需要复核", "证据校验", "已通过证据检查", "后台评估", "judge")),
)
SMALLTALK = ("天气", "讲个笑话", "写首诗", "闲聊", "今天星期几", "新闻", "股票", "电影")
PRONOUNS = ("它", "这个", "上述", "前面", "该", "其", "那个")
REFUSALS = ("证据不足", "无法可靠回答")
TEST_INSTRUCTIONS = ("test", "测试", "链路测试", "规则路由复测")
MOJIBAKE = ("æ", "ç", "è", "ä", "å", "ï¼", "ã", "\u0080", "\u0098", "\u009d", "\u0081")

# Latin letters with diacritics and the letters that stand for them in the index and in slugs.
ACCENTED = "àáâãäåāèéêëēìíîïīòóôõöōùúûüūñçýÿ"
PLAIN = "aaaaaaaeeeeeiiiiioooooouuuuuncyy"

# Patterns of labels that are no entities (page ranges, chapter heads, manual titles), of broken encodings,
# and of numbers. Two labels that LABEL_FRAGMENTS covers are not repeated among STOP_LABELS.
GENERIC_LABELS = (
    "(?i)^pages?\\s+\\d+(\\s*[-–]\\s*\\d+)?$",
    "(?i)^introduction\\s*/",
    "(?i)^mathworks[\\w\\s-]*r20\\d{2}[ab]?$",
    "(?i)^.*\\b(user guide|getting started guide)\\s+r20\\d{2}[ab]?$",
)
BROKEN_LABEL = "(?iu)[ÃÂ\ufffdæçåèéäöü]|(?:\\\\u00[0-9a-f]{2})"
NUMBER_LABELS = ("(?i)^E\\s*:\\s*\\d+$", "^\\d+(\\.\\d+)*$")

# Labels that are no entities, single words that are, synonyms, and types by keyword.
STOP_LABELS = ("a", "an", "and", "as", "by", "for", "from", "if", "in", "into", "of", "on", "or", "the", "this", "to", "with", "page", "pages", "source", "evidence", "summary", "note", "notes", "overview", "证据摘要", "编译说明", "来源章节", "核心结论", "introduction", "layout", "system", "systems", "example", "examples", "chapter", "section", "appendix", "contents", "index", "getting started guide", "user guide", "getting started guide r2026a", "create", "validate", "open", "close", "change", "set", "run", "view", "show", "find", "select", "design", "核心结论与关键步骤", "编译规则", "相关概念", "注意事项")
LABEL_FRAGMENTS = ("核心结论", "关键步骤", "编译规则", "相关概念", "注意事项", "的关系", "关系说明", "证据摘要", "编译说明", "来源章节")
SINGLE_WORDS = ("simulink", "stateflow", "autosar", "matlab", "solver", "model", "chart", "block", "signal", "bus", "composition", "component", "runnable", "interface", "calibration", "simulation", "coverage", "arxml", "coder", "dictionary")
SYNONYMS = {
    "automotive open system architecture": "AUTOSAR",
    "simulink/autosar": "Simulink AUTOSAR integration",
    "autosar components": "AUTOSAR Component",
    "autosar component creation": "AUTOSAR Component",
    "autosar software architecture modeling": "AUTOSAR Software Architecture",
    "autosar code generation": "AUTOSAR Code Generation",
    "autosar dictionary": "AUTOSAR Dictionary",
    "simple simulink model": "Simulink Model",
    "navigate a simulink model": "Simulink Model Navigation",
    "modeling in simulink": "Simulink Modeling",
    "modeling": "Model-Based Design",
    "model": "Simulink Model",
    "simulation": "Simulation",
    "embedded coder": "Embedded Coder",
    "classic platform": "AUTOSAR Classic Platform",
    "simple simulink model / create a simple model": "Simulink Model",
    "matlab/simulink": "MATLAB Simulink",
}
LABEL_PREFIXES = (
    ("mathworks_simulink_getting_started", "Simulink Getting Started"),
    ("mathworkssimulinkgettingstarted", "Simulink Getting Started"),
    ("mathworks_autosar_blockset", "AUTOSAR Blockset"),
    ("autosar blockset user guide", "AUTOSAR Blockset"),
    ("overview of autosar support", "AUTOSAR Support"),
)
PHRASE_STOPS = ("The", "This", "For", "Source", "Page", "Pages", "Evidence", "MATLAB", "To", "In", "On", "Of")
TYPE_KEYWORDS = (
    ("product", ("simulink", "stateflow", "autosar", "matlab")),
    ("component", ("solver", "block", "chart", "composition", "component", "model")),
    ("workflow", ("import", "export", "generate", "test", "simulation", "workflow")),
    ("method", ("method", "strategy", "algorithm", "coverage")),
)
RELATION_TYPES = ("relates_to", "part_of", "used_for", "affects", "requires", "contrasts_with")
ENTITY_TYPES = ("product", "concept", "method", "component", "workflow", "document", "tool", "other")

# What an answer of each role may be, the prompt, and the texts where evidence is lacking.
PROMPT_TURNS = 12
CONTRACTS = {
    "definition": "用 2-3 句简洁中文回答，不要展开背景材料。每一句事实性结论都必须带 [E:n] 引用。",
    "relationship": "最多用 3 个小段说明：核心关系、映射/集成方式、证据边界。保持简洁，每一句事实性结论都必须带 [E:n] 引用。",
    "comparison": "用紧凑中文对比，只写证据支持的差异点。每一句事实性结论都必须带 [E:n] 引用。",
    "procedure": "最多用 4 个编号步骤或要点回答。每个步骤都必须带 [E:n] 引用。",
    "general": "最多用 4 个简洁中文要点或短段落回答。每一句事实性结论都必须带 [E:n] 引用。",
}
NOTHING = "无"
PROMPT = """你是本地 Simulink / AUTOSAR / Stateflow 知识助手。用户用中文提问时，除英文技术名词、函数名和产品名外，必须用中文回答。
硬性规则：
1. 技术事实只能来自下面的证据。
2. 每一句事实性结论末尾都必须带 [E:数字] 引用。
3. 证据不足时直接说明，不要编造。
4. 不要把目录、页眉页脚、版权页当成主要事实依据。
5. {}
6. 不要输出英文段落标题，例如 Core Relationship、Mapping/Integration；中文问题请使用中文标题或不要使用标题。
7. 不要复制证据原文作为答案尾巴；只输出你整理后的最终回答。

用户偏好与项目上下文（不是技术证据）：
{}

最近对话：
{}

当前问题：
{}

证据：
{}
"""
LIST_MARK, KEY_TERMS_TEXT = "、", "关键术语"
UNCOVERED = "当前知识库中没有足够证据可靠回答这个问题。检索到的资料没有覆盖问题中的关键约束：{}。你可以导入包含这些内容的官方文档，或换一个已入库资料覆盖的问题。"
NOTHING_FOUND = (
    "当前资料范围内没有找到足够证据，因此我不直接编造答案。",
    "你现在启用了资料筛选，可以先切回“全库”再试。",
    "本轮实际检索词：{}。可以换成更接近文档标题、模块名或英文术语的问法。",
    "如果这是新领域问题，建议先导入对应的 Simulink、AUTOSAR 或 Stateflow 文档。",
)
INDEX_HEAD, INDEX_SECTIONS, INDEX_RULES = "来源章节", "- [[{}]]：{} 个证据块，页面 `{}`{}", ("编译规则", "- 原始文件不可变保存；本页与章节页均可从 evidence chunks 重建。", "- 章节页必须包含原始证据引用；模型输出无引用时自动降级为证据摘要页。")
