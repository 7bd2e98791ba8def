"""The rule pack of business signals, of what a sentence is about, and of a company's profile, as data.

All patterns are read without regard to case, with ASCII word characters and ASCII white space.
"""

from __future__ import annotations

# Signal, its patterns in order, and patterns whose presence around a match takes it back.
SIGNALS = (
    ("new_facility", (
        r"\bnew\s+(?:plant|factory|facil\w+|campus|hub|manufactur\w+\s+unit)\b",
        r"\bopening\s+(?:a\s+)?(?:new\s+)?(?:plant|factory|facil\w+)\b",
        r"\bgroundbreaking\s+(?:ceremony|event|for\s+new)\b",
        r"\bgreenfield\s+(?:plant|factory|facil\w+|site)\b",
        r"\bcommission(?:ing|ed)\s+(?:a\s+)?(?:new\s+)?(?:plant|line|unit)\b",
    ), ()),
    ("capacity_expansion", (
        r"\bexpand(?:ing|ed|s)?\s+(?:our\s+)?(?:capacity|production|manufactur\w+)\b",
        r"\bcapacity\s+(?:expansion|investment|increase)\b",
        r"\bnew\s+production\s+(?:line|unit|facility|block)\b",
        r"\bincreas(?:ing|ed|e)\s+(?:production|manufacturing|output)\s+capacity\b",
        r"\badditional\s+(?:production|manufacturing)\s+(?:lines?|capacity|units?)\b",
    ), ()),
    ("new_market_entry", (
        r"\bentering\s+(?:the\s+)?(?:new\s+)?(?:\w+\s+)?market\b",
        r"\bexpanding\s+into\s+(?:new\s+)?(?:\w+\s+)?(?:market|geograph\w+|countr\w+|segment)\b",
        r"\bnew\s+(?:geograph\w+|market)\s+(?:expan\w+|entr\w+)\b",
        r"\bexpanding\s+(?:its\s+|our\s+)?(?:presence|business|operations?)\s+(?:into|in)\s+(?:capital\s+goods|infrastructure|defence|defense|aerospace|energy|railways?|new\s+(?:sector|vertical|segment|domain|market))\b",
        r"\bexpanding\s+into\s+(?:capital\s+goods|infrastructure|defence|defense|aerospace|energy|railways?|new\s+(?:sector|vertical|segment|domain))\b",
        r"\bexpanding\s+(?:its\s+|our\s+)?(?:presence|business|operations?)\s+(?:into|in)\s+(?:new\s+)?(?:\w+\s+)?(?:sector|vertical|segment|market|domain)\b",
        r"\bdiversif(?:ying|ication)\s+(?:into|of|our|its)\s+(?:portfolio|business|revenue|product\s+mix|operations?)\b",
        r"\bventuring\s+into\s+(?:new\s+)?(?:\w+\s+)?(?:sector|market|domain|vertical|territory)\b",
        r"\bexpanding\s+globally\b",
        r"\bglobal\s+expansion\s+(?:strategy|plan|initiative|push|drive)\b",
    ), (r"stock\s+market|capital\s+market|financial\s+market",)),
    ("revenue_milestone", (
        r"\brevenue\s+(?:grew|increased|of|reached|crossed|exceeded)\s+",
        r"\brecord\s+(?:revenue|turnover|sales)\b",
        r"\b(?:turnover|revenue)\s+of\s+(?:rs\.?|inr|usd|\$|€|£)?\s*[\d,]+",
        r"\b\d+%?\s+(?:revenue\s+)?growth\b",
    ), ()),
    ("digital_transformation_hiring", (
        r"\b(?:sap|erp)\s+(?:consultant|specialist|analyst|lead|manager)\b",
        r"\bdigitali[sz]ation\s+(?:lead|manager|head|specialist)\b",
        r"\bdata\s+(?:analyst|engineer|architect|manager)\b",
        r"\bdigital\s+transformation\s+(?:lead|manager|head)\b",
        r"\bsystems?\s+analyst\b",
    ), ()),
    ("ai_ml_hiring", (
        r"\b(?:ai|machine\s+learning|ml)\s+engineer\b",
        r"\bdata\s+scientist\b",
        r"\bcomputer\s+vision\s+engineer\b",
        r"\b(?:nlp|deep\s+learning)\s+(?:engineer|researcher|specialist)\b",
        r"\bhiring\s+(?:for\s+)?ai\b",
    ), ()),
    ("automation_engineering_hiring", (
        r"\bautomation\s+engineer\b",
        r"\bcontrols?\s+engineer\b",
        r"\brobotic[s]?\s+engineer\b",
        r"\bplc\s+(?:programmer|engineer|technician)\b",
        r"\bmechatronics?\s+engineer\b",
    ), ()),
    ("operations_hiring_surge", (
        r"\b(?:production|manufacturing|quality|maintenance|operations)\s+(?:supervisor|manager|engineer|coordinator|technician)\b",
        r"\bopen(?:ing|s)?\s+(?:positions?|roles?|vacancies)\s+in\s+(?:production|manufacturing|operations)\b",
        r"\bqc\s+inspector\b",
        r"\bshift\s+(?:supervisor|manager|lead)\b",
    ), ()),
    ("leadership_hiring", (
        r"\b(?:vp|vice\s+president|director|head)\s+of\s+(?:operations?|manufactur\w+|digital|technology)\b",
        r"\b(?:coo|cto|cdo|chief\s+(?:operating|technology|digital)\s+officer)\b",
        r"\bleadership\s+team\s+expand",
    ), ()),
    ("digital_transformation", (
        r"\bai[\s-]powered\s+digitali[sz]ation\b",
        r"\bdigitali[sz](?:ing|ation|ing)\s+(?:our|the)\s+(?:manufactur\w+|factory|factories|operations?|production|processes?|plant)\b",
        r"\btransition(?:ing|ed)?\s+from\s+traditional\s+(?:methods?|processes?|operations?|manufactur\w+)\s+to\b",
        r"\bdigital\s+transformation\s+(?:initiative|journey|program|roadmap|drive|project|strategy)\b",
        r"\bdigitally\s+transform(?:ing|ed)\s+(?:our|the|manufacturing|operations?)\b",
        r"\bour\s+digitali[sz]ation\s+(?:journey|initiative|efforts?|program|roadmap)\b",
        r"\bmanufacturing\s+(?:digitali[sz]ation|modernization)\s+(?:initiative|program|journey|drive|effort)\b",
        r"\bdigitali[sz](?:ing|e)\s+(?:our|the)\s+(?:factory|factories|plant|operations?|manufactur\w+|supply\s+chain)\b",
        r"\bsmart\s+manufacturing\s+(?:initiative|program|journey|roadmap|strategy)\b",
        r"\bfactory\s+(?:of\s+the\s+future|modernization\s+initiative)\b",
        r"\bdigital\s+(?:manufacturing|factory)\s+(?:initiative|program|journey|transformation)\b",
        r"\bnext[\s-]gen(?:eration)?\s+manufactur\w+\b",
    ), (
        r"help(?:ing|s)?\s+(?:you|your)\s+(?:with\s+(?:their\s+)?)?(?:digital|digitali)",
        r"(?:enable|support|accelerate)\s+your\s+(?:digital|digitali)",
    )),
    ("industry40_initiative", (
        r"\bindustry\s+4\.0\b",
        r"\bsmart\s+factory\b",
        r"\biiot\b|\bindustrial\s+internet\s+of\s+things\b",
        r"\bdigital\s+twin\b",
        r"\bdigital\s+factory\b",
        r"\bconnected\s+(?:factory|plant|manufacturing)\b",
        r"\bsmart\s+manufactur\w+\b",
        r"\badvanced\s+manufactur\w+\s+(?:technolog|platform|initiative|solution|center)\b",
        r"\bai[\s-]powered\s+(?:manufactur\w+|factory|production|operations?)\b",
    ), ()),
    ("erp_implementation", (
        r"\bsap\s+s/4hana\b",
        r"\berp\s+(?:implementation|rollout|go-live|deployment|upgrade|transition)\b",
        r"\bimplementing\s+(?:sap|oracle|erp|dynamics)\b",
        r"\bsap\s+(?:implementation|go-live|migration|upgrade)\b",
        r"\boracle\s+(?:erp|cloud|fusion)\s+(?:implementation|go-live)\b",
    ), ()),
    ("mes_adoption", (
        r"\bmes\b|\bmanufacturing\s+execution\s+system\b",
        r"\bshop\s+floor\s+digitali[sz]ation\b",
        r"\bproduction\s+management\s+system\b",
    ), ()),
    ("automation_investment", (
        r"\bautonomous\s+(?:truck|vehicle|driv\w+|transport|guided)\b",
        r"\bself-?driving\s+(?:truck|vehicle|machin\w*)\b",
        r"\bautomation\s+(?:investment|program|initiative|capex|rollout)\b",
        r"\bnew\s+(?:automated|robotic)\s+(?:line|system|cell)\b",
        r"\brobot(?:ic)?\s+(?:installation|deployment|integration)\b",
        r"\bautomating\s+(?:our|the)\s+(?:production|assembly|welding|inspection|manufactur\w+|operations?|processes?)\b",
        r"\binvest\w*\s+in\s+(?:factory\s+)?(?:automation|robotics?)\b",
        r"\bautomation\s+(?:journey|roadmap|agenda|drive|push|effort)\b",
        r"\bindustrial\s+automation\s+(?:initiative|program|investment|journey)\b",
        r"\b(?:r&d|research\s+and\s+development)\s+and\s+automation\b",
        r"\bthrough\s+(?:advanced\s+)?automation\b",
        r"\bautomated\s+(?:production|assembly|manufacturing|factory|plant)\b",
    ), ()),
    ("iot_investment", (
        r"\biiot\s+(?:platform|sensors?|deployment|integration)\b",
        r"\bconnected\s+(?:machines?|equipment|sensors?)\b",
        r"\breal-time\s+(?:monitoring|data|visibility)\s+(?:across|for)\s+(?:our|the)?\s*(?:plant|factory|production)",
        r"\bpredictive\s+analytics\s+(?:platform|infrastructure|deployment)\b",
    ), ()),
    ("ai_mention", (
        r"\bai-powered\b|\bai\s+powered\b",
        r"\bartificial\s+intelligence\s+(?:adoption|strategy|deploy\w+|for\s+(?:manufactur|operat|product))",
        r"\bartificial\s+intelligence\s+(?:program|initiative|platform|investment|deployment)\b",
        r"\bmachine\s+learning\s+(?:model|platform|solution|program)\b",
        r"\bdeploying\s+(?:ai|artificial\s+intelligence)\b",
        r"\bai\s+(?:initiative|strategy|roadmap|investment|transformation)\b",
    ), (r"our\s+(?:customers?|clients?)\s+use\s+ai", r"we\s+(?:sell|provide|offer)\s+ai")),
    ("multi_location_operations", (
        r"\b(?:plants?|facilit\w+|locations?|factor(?:y|ies))\s+(?:across|in|spanning)\s+(?:\d+|multiple|several|many)",
        r"\b\d{2,}\s+(?:plants?|facilit\w+|locations?|offices?|branches?|factor(?:y|ies))\b",
        r"\b(?:two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|fifteen|twenty)\s+(?:\w+\s+)?(?:plants?|facilit\w+|sites?|locations?|factor(?:y|ies))\b",
        r"\b(?:manufactur\w+|production)\s+units?\b",
        r"\b(?:plants?|facilit\w+|sites?|factor(?:y|ies))\s+(?:nationwide|pan[-\s]india|across\s+(?:india|the\s+country|the\s+globe|the\s+region))\b",
        r"\boperations?\s+(?:across|in)\s+\d+\s+(?:countries?|states?|cities?)\b",
        r"\bglobal\s+(?:manufactur\w+|operations?|footprints?|presence)\b",
        r"\bglobal\s+(?:manufactur\w+|production)\s+(?:network|footprints?|base|presence)\b",
        r"\bour\s+(?:global|international|worldwide)\s+(?:manufactur|operat|product)\w*\s+(?:footprints?|network|presence|base)\b",
        r"\bmanufacturing\s+footprints?\b",
        r"\bmulti-(?:plant|site|location)\b",
        r"\boperations?\s+in\s+(?:more\s+than\s+)?\d+\s+(?:countries?|markets?)\b",
        r"\bpresence\s+in\s+(?:more\s+than\s+)?\d+\s+countries\b",
        r"\b\d+\s+(?:countries?|markets?|regions?)\s+(?:worldwide|globally|around\s+the\s+world)\b",
        r"\b\d{2,}\s+(?:countries?|markets?)\b",
        r"\b\d{2,}\s+(?:production\s+)?(?:plants?|facilit\w+|sites?)\s+(?:worldwide|globally|around)\b",
    ), ()),
    ("acquisition", (
        r"\b(?:acquired?|acquisition\s+of|merger\s+with|merged\s+with)\b",
        r"\bstrategic\s+acquisition\b",
        r"\bancquiring\b|\bjoining\s+forces\s+with\b",
    ), (r"customer\s+acqui\w+|talent\s+acqui\w+",)),
    ("quality_certification_pursuit", (
        r"\b(?:iatf|iatf\s+16949|iso\s+9001|as9100|iso\s+14001)\s+(?:certified?|certification|recertif\w+|pursuit|achieve\w*)\b",
        r"\bpursu(?:ing|ed)\s+(?:iso|iatf|as9100)\s+certification\b",
        r"\bachiev(?:ed|ing)\s+(?:iso|iatf)\s+\d+\s+certification\b",
    ), ()),
    ("sustainability_initiative", (
        r"\bcarbon\s+(?:neutral|reduction|net\s+zero|footprint)\b",
        r"\besg\s+(?:program|initiative|commitment|target|report)\b",
        r"\bsustainability\s+(?:goal|target|program|roadmap)\b",
        r"\bgreen\s+(?:manufactur\w+|energy|factory)\b",
    ), ()),
    ("named_erp_crm_tool", (
        r"\bsap\s*\(?\s*(?:mm|fico|fi/co|sd|pp|hr|hcm|qm|wm|ewm|bw|crm)\b",
        r"\b(?:oracle\s+erp|salesforce|netsuite|workday|microsoft\s+dynamics|tableau|power\s*bi|quickbooks|zoho\s+(?:crm|books|one))\b",
        r"\bknowledge\s+of\s+(?:sap|erp|crm)\b",
        r"\b(?:experience|expertise|proficiency)\s+(?:in|with)\s+(?:sap|erp|crm|oracle|salesforce)\b",
    ), ()),
    ("external_training_engagement", (
        r"\bworkshop\s+(?:on|for|focused\s+on)\b",
        r"\b(?:conduct|conducted|organi[sz]ed?|organi[sz]ing)\s+(?:a\s+|an\s+)?(?:workshop|training\s+(?:program|session))\b",
        r"\btraining\s+(?:program|session)\s+(?:on|for|to)\b",
        r"\bengaged?\s+(?:a\s+|an\s+)?(?:consultant|trainer|facilitator)\b",
    ), ()),
)

# The factors that a signal stands for.
SIGNAL_FACTORS = (
    ("new_facility", "growth_signal"), ("capacity_expansion", "capacity_expansion"), ("new_market_entry", "growth_signal"), ("revenue_milestone", "growth_signal"),
    ("digital_transformation_hiring", "hiring_signal"), ("ai_ml_hiring", "hiring_signal"), ("automation_engineering_hiring", "hiring_signal"), ("operations_hiring_surge", "hiring_signal"),
    ("leadership_hiring", "hiring_signal"), ("digital_transformation", "digital_transformation"), ("industry40_initiative", "industry_40_initiative"), ("erp_implementation", "digital_transformation"),
    ("mes_adoption", "digital_transformation"), ("automation_investment", "automation_keywords"), ("iot_investment", "technology_investment"), ("ai_mention", "ai_mention"),
    ("multi_location_operations", "multi_location_operations"), ("acquisition", "recent_news_or_event"), ("quality_certification_pursuit", "recent_news_or_event"),
    ("sustainability_initiative", "recent_news_or_event"), ("named_erp_crm_tool", "technology_investment"),
    ("industry40_initiative", "technology_investment"), ("iot_investment", "digital_transformation"), ("digital_transformation", "technology_investment"),
)

# Words of legal forms, and first words that are too common to stand for a company.
LEGAL_FORMS = r"\b(?:pvt\.?|private|ltd\.?|limited|inc\.?|incorporated|llc|corp\.?|corporation|co\.?)\b"
COMMON_FIRST = ("the", "a", "an", "group", "global", "national", "international", "united", "american", "indian", "general", "premier", "prime", "advanced", "modern", "new", "smart", "digital", "tech", "star", "sun", "royal", "elite", "supreme", "leading", "first", "top", "best", "world", "universal")

# What a quote is about: (subject, page types or none for all, pattern, pattern that must be absent or none).
OUTSIDE = (
    ("customer_use_case", r"(?:our|the)\s+(?:customer|client)s?\s+(?:benefit|gain|achieve|report|see|use|can)\b"),
    ("customer_use_case", r"we\s+(?:help|enable|empower|support)\s+(?:our\s+)?(?:customer|client)s?\b"),
    ("partner_story", r"\b(?:case\s+stud(?:y|ies)|success\s+stor(?:y|ies)|customer\s+stor(?:y|ies))\b"),
    ("partner_story", r"\b(?:our\s+partner|our\s+collaboration\s+with|worked\s+with|collaborated\s+with)\b"),
    ("product_capability", r"our\s+(?:platform|software|service|tool)\s+(?:provide|offer|enable|help|allow|let|give)\b"),
    ("product_capability", r"with\s+(?:our|the)\s+(?:platform|solution),\s+you\s+can\b"),
    ("product_capability", r"\bfeature(?:s)?\s+include\b"),
)
OWN_PAGES = (("careers", "company_operations"), ("investor", "company_strategy"), ("annual_report", "company_strategy"), ("press", "company_strategy"))
ADDRESSED, OWN_PEOPLE = r"\b(?:you|your)\b", r"\bour\s+(?:team|employees|people|workforce)\b"
FIRST_PERSON = (
    ("company_operations", r"\bwe\s+(?:are|have|do|build|manufactur|operat|produc|assembl|forg|stamp|cast|weld|machine|offer)\b", None),
    ("company_operations", r"\bour\s+(?:plant|facility|facilities|factory|factories|team|workforce|operation|production|manufactur)\b", None),
    ("company_operations", r"\bour\s+(?:employees|workers|staff|people|headcount)\b", None),
    ("company_operations", r"\bour\s+(?:global|international|worldwide)\s+(?:manufactur|operat|product)\w*\b", None),
    ("company_strategy", r"\b(?:we|our\s+(?:company|group))\s+(?:announced|plan(?:ned)?|intend|will\s+(?:open|expand|launch|invest|acquire)|aim\s+to)\b", None),
    ("company_strategy", r"\bour\s+(?:strategy|roadmap|vision|mission|goal|objective|commitment)\b", r"customer"),
    ("company_strategy", r"\bglobal\s+(?:manufactur|production|operat)\w+\s+(?:network|footprints?|presence|base)\b", None),
    ("internal_technology", r"\bwe\s+(?:are\s+deploying|deploy(?:ed|ing)|implement(?:ing|ed)|rolling\s+out|invest(?:ing|ed)\s+in)\b", None),
)
MODERN, SOLD = r"\b(?:industry\s*4\.0|smart\s+factory|iiot|digital\s+twin|ai[\s-]powered|artificial\s+intelligence)\b", r"\b(?:our\s+(?:customer|client)|help\s+(?:you|your)|enable\s+(?:you|your)|for\s+(?:your|our\s+customer))\b"
TO_CUSTOMERS, THE_COMPANY = r"\b(?:help|enable|your\s+company|our\s+customer)\b", r"\b(?:the\s+company|the\s+group|the\s+firm)\s+\w+"
NAMED_PAGES = ("other", "about", "homepage", "products", "blog")
SLOGANS = (r"\bleading\s+(?:provider|manufacturer|supplier|global)\b", r"\bworld[\s-]class\b|\binnovation\s+at\s+(?:its\s+)?core\b")
TREND = r"\bthe\s+(?:industry|market|sector)\s+(?:is|has|are)\b"
OWN_SUBJECTS = ("company_operations", "company_strategy", "internal_technology")
FLOOR_SUBJECTS = ("industry_trend", "product_capability")

# Flags of a company's profile. Consumer goods count for retail only without industrial context.
PROFILE = (
    ("manufacturer", (
        r"manufactur\w+\s+(?:company|facilit|plant|unit)", r"production\s+(?:facility|plant|line)", r"\b(?:forging|casting|stamping|machining|fabricat\w+|assembly)\s+(?:line|plant|facilit|unit)",
        r"\b(?:six|five|four|three|two|multiple|several|\d+)\s+manufacturing\s+(?:facilit|plant|unit)", r"welding\s+(?:company|manufactur)", r"we\s+manufactur", r"our\s+manufactur\w+\s+facilit",
        r"\b(?:component|forging|casting|stamping|fabricat\w+|precision|contract|industrial|automotive)\s+manufacturer\b", r"\bwe\s+are\s+(?:a|an|the)\s+(?:\w+\s+){0,2}manufacturer\b",
        r"\bmanufactur\w+\s+and\s+export(?:ing|s|ed)?\b",
        r"\bleader\s+in\s+(?:forgings?|castings?|stampings?|machining|fabrication|manufactur\w+|(?:precision|high[\s-]performance|engineered)\s+components?)\b",
        r"\bour\s+(?:forging|casting|stamping|machining|fabrication|welding)\s+operations?\b", r"\b(?:forging|casting|stamping|fabrication|machining)\s+(?:company|business|operations?)\b",
        r"\b(?:years?|decades?|century|centuries)\s+of\s+manufactur\w+", r"\b(?:forging|casting|stamping|machining|fabricat\w+|assembly)\b[^.\n]{0,40}?\b(?:facilit\w*|plant|unit)\b")),
    ("industrial_vendor", (
        r"welding\s+(?:equipment|solution|automation|machine|system)", r"industrial\s+(?:automation|technology|equipment)\s+(?:vendor|provider|supplier)", r"machine\s+(?:builder|maker|manufacturer)\s+(?:for|serving)",
        r"manufactur\w+\s+(?:equipment|solution|automation)\s+(?:provider|supplier)", r"(?:automation|robotic|welding|cutting)\s+solution", r"(?:consumables?|equipment)\s+(?:for\s+)?(?:welding|cutting|manufactur)")),
    ("software_saas", (
        r"\bsaas\b|\bsoftware[\s-]as[\s-]a[\s-]service\b", r"\bcloud\s+(?:platform|software|erp|crm)\b", r"subscription[\s-]based\s+software", r"\bapi[\s-]first\b|\bpaas\b|\bplatform[\s-]as[\s-]a[\s-]service\b",
        r"\bsubscription\s+(?:billing|management|platform|software|analytics)\b", r"\bbilling\s+(?:platform|software|management|automation)\b", r"\brecurring\s+(?:billing|revenue|payments)\b",
        r"\brevenue\s+(?:operations|management)\s+(?:platform|software)\b")),
    ("services_provider", (
        r"\b(?:consulting|advisory|professional\s+services)\b", r"engineering\s+services?\s+(?:company|provider|firm)", r"product\s+(?:design|development|engineering)\s+services", r"\br&d\s+services?\b", r"managed\s+services?\s+provider")),
    ("retailer", (r"\bretail\s+(?:store|chain|network|outlet)\b", r"\b(?:supermarket|hypermarket|mall)\b")),
    ("logistics_operator", (r"\b(?:freight|3pl|third.?party\s+logistics|courier|shipping)\s+(?:company|provider|services?)\b", r"\bwarehouse\s+(?:and|&)\s+distribution\b", r"\blast[\s-]mile\s+delivery\b")),
    ("financial_institution", (
        r"\b(?:insurance|nbfc|mutual\s+fund|asset\s+management|investment\s+bank)\b", r"(?<!data\s)(?<!food\s)(?<!test\s)(?<!word\s)(?<!blood\s)(?<!piggy\s)(?<!river\s)\bbank\b",
        r"\bfinancial\s+services?\s+(?:company|provider|firm)\b", r"\b(?:loan|deposit|credit\s+card|mortgage|npa)\b")),
    ("healthcare_provider", (
        r"\b(?:hospital|clinic|medical\s+devices?)\b", r"\bdiagnostic(?:s)?\s+(?:cent(?:er|re)|lab(?:oratory)?|imaging|patholog\w*|radiology|facilit\w*)\b", r"\b(?:patholog\w*|radiology|medical\s+imaging)\b",
        r"\bhealthcare\s+(?:provider|services?|company)\b")),
    ("pharma_biotech", (r"\b(?:pharmaceutical|pharma|biotech|drug\s+manufactur|api\s+manufactur)\b", r"\b(?:clinical\s+trial|fda|usfda|anda)\b")),
    ("conglomerate", (r"\b(?:group|holding|conglomerate)\s+(?:compan|with\s+(?:diverse|multiple|varied))", r"\bdiverse\s+(?:portfolio|businesses|industries|sectors)\b", r"\bmultiple\s+business\s+(?:unit|segment|division)")),
)
CONSUMER_GOODS = r"\bfmcg\b|\bconsumer\s+goods\b"
INDUSTRIAL_CONTEXT = r"\b(?:automotive|passenger\s+vehicle|commercial\s+vehicle|forging|casting|stamping|machining|oem|tier[\s-]?1\s+supplier)\b"
PRIMARY = ("software_saas", "industrial_vendor", "manufacturer", "services_provider", "financial_institution", "pharma_biotech", "healthcare_provider", "logistics_operator", "retailer", "conglomerate")
ROBOTICS, SOFTWARE_PLATFORM = r"\b(?:robot\w*|cobot|automation|cnc\s+machine)\b", r"\bcloud\s+platform|saas\s+platform|api\s+platform|software\s+platform\b"
RESEARCH_CENTER = r"\br&d\s+cent(?:re|er)|research\s+and\s+development\s+cent(?:re|er)|research\s+cent(?:re|er)"

# Page types by path, in order.
PAGE_TYPES = (
    ("careers", r"/(?:careers|jobs|hiring|vacancies|work-with-us|join-us|open-positions|opportunities)"),
    ("investor", r"/(?:investor|ir|annual-report|shareholders|financial|earnings|results|reports)"),
    ("annual_report", r"/(?:annual[_-]?report|ar20\d{2})"),
    ("press", r"/(?:press|news|newsroom|media|announcements|press-releases?|pressroom)"),
    ("about", r"/(?:about|about-us|company|our-story|who-we-are|overview|corporate)"),
    ("products", r"/(?:products?|solutions?|services?|capabilities|offerings|platforms?)"),
    ("blog", r"/(?:blog|insights?|perspectives?|thought-leadership|articles?)"),
    ("homepage", r"^/?(?:index\.html?)?$|/home/?$"),
)

#: Edge of a word of ASCII letters, digits and underscores; the engine's own sign also counts letters of other scripts.
EDGE = r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))"


def spark_pattern(pattern: str) -> str:
    """A rule as a pattern of Spark's: in any case, with edges of ASCII words."""
    return "(?i)" + pattern.replace(r"\b", EDGE)


#: One row per pattern: (signal, pattern, patterns that take it back joined to one, or none).
PATTERNS = [(signal, pattern, "|".join(f"(?:{a})" for a in anti) or None) for signal, patterns, anti in SIGNALS for pattern in patterns]
