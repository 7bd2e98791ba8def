"""Rules by which a company's own words show a need for a kind of service, and drafts of offers, as data."""

from __future__ import annotations

# Service, pattern that rules it out or none, strong, medium and weak patterns. All in any case.
BY_TEXT = (
    ("AI-powered business applications", r"\bour\s+(?:in-house|internal)\s+(?:ai|data\s+science)\s+team\b",
     (r"\bmanual(?:ly)?\b[^.]{0,60}\b(?:review|scor(?:e|ing)|triage|prioritiz\w+|allocat\w+)\b",),
     (r"\b(?:dealer|distributor|distribution)\s+network\b", r"\bregional\s+offices?\b", r"\bfield\s+teams?\b", r"\bacross\s+(?:regions|territories|multiple\s+markets)\b"),
     (r"\bdata-driven\b",)),
    ("Custom SaaS platforms", None,
     (r"\bno\s+(?:software|tool|system)\s+(?:fits|supports|handles)\b[^.]{0,80}\b(?:growth|scal\w+|expand\w+)\b",),
     (r"\b(?:our\s+own|internal|proprietary|custom-built)\s+(?:tool|system|process)\b",),
     (r"\bwe\s+use\s+spreadsheets?\b", r"\b(?:manag\w+|track\w+)\s+(?:via|through|using)\s+(?:excel|spreadsheets?)\b")),
    ("Ecommerce ecosystems", None,
     (r"\b(?:expand\w+|scal\w+|grow\w+)\b[^.]{0,80}\b(?:channels?|marketplaces?|storefronts?)\b",),
     (r"\b(?:amazon|flipkart|myntra|nykaa)\b", r"\bomnichannel\b", r"\b(?:own\s+site|website)\s+(?:and|as\s+well\s+as)\s+(?:marketplaces?|social\s+commerce)\b"),
     (r"\b(?:shop|store)\s+(?:now|page)\b|\badd\s+to\s+cart\b",)),
    ("Marketplace platforms", None,
     (r"\bonboard(?:ing)?\s+(?:partners?|vendors?|merchants?|sellers?)\b[^.]{0,60}\b(?:challenge|scal\w+|growth|goal)\b",),
     (r"\b(?:vendors?|sellers?|merchants?)\s+(?:network|onboarding)\b", r"\b(?:buyers?\s+and\s+sellers?|drivers?\s+and\s+riders?|vendors?\s+and\s+customers?)\b"),
     (r"\bpartners?\b",)),
    ("Workflow automation systems", r"\bprocess\s+is\s+(?:fully\s+)?(?:automated|system-driven)\b",
     (r"\b(?:delay|error|missed\s+deadline|backlog|sla\s+breach)\w*\b[^.]{0,80}\b(?:complaint|ticket|order|approval|process)\b",),
     (r"\b(?:complaint|ticket|order|approval)s?\s+(?:lifecycle|process|workflow)\b", r"\b(?:multiple|various|several)\s+(?:teams|departments)\s+(?:handle|process|manage|touch)"),
     (r"\bour\s+team\s+(?:processes|handles|manages)\b", r"\bcustomer\s+service\s+process\b")),
)
GROWING_ONLY, NOT_FOR_SAAS = "Custom SaaS platforms", "Custom SaaS platforms"
INTERNAL = ("Internal operational software", r"\b(?:our\s+)?(?:erp|internal\s+(?:system|platform)|operations?\s+platform)\b[^.]{0,40}\b(?:works?\s+well|robust|proven|established)\b", r"\b(?:monthly|weekly)\s+reports?\b|\bHQ\b[^.]{0,60}\bvisibility\b")
ANALYTICS = ("Analytics and reporting systems", r"\b(?:powered\s+by|using|built\s+on)\s+(?:tableau|looker|power\s*bi|qlik)\b", r"\b(?:dealer|distributor|franchise)\s+network\b", r"\b(?:our\s+)?(?:data|insights)\b[^.]{0,40}\b(?:drive|power|inform)\b")
#: The last pattern is a lone "AI" that no hyphen follows, written without look-ahead.
INTEGRATION = (
    "AI integrations and intelligent automation", r"\bai-(?:powered|driven|enabled)\s+(?:crm|erp|chatbot|assistant)\b[^.]{0,40}\balready\b",
    r"\bsap\s*\(?\s*(?:mm|fico|fi/co|sd|pp|hr|hcm|qm|wm|ewm|bw|crm)\b|\b(?:oracle\s+erp|salesforce|netsuite|workday|microsoft\s+dynamics|zoho\s+(?:crm|books|one))\b",
    r"\bour\s+team\s+(?:creates?|writes?|produces?|generates?)\b[^.]{0,60}\b(?:weekly|monthly|daily|regularly)\b", r"\bai\b\s*(?:[^\s-]|$)")

# Factors that say nothing about a company of a business model.
MEANINGLESS = (
    ("Software/SaaS", ("industry_40_initiative", "automation_keywords", "multi_location_operations", "capacity_expansion", "digital_transformation")),
    ("Engineering Services", ("industry_40_initiative", "automation_keywords", "multi_location_operations", "capacity_expansion", "digital_transformation")),
    ("Distribution/Logistics", ("industry_40_initiative", "automation_keywords")),
    ("Industrial Technology Vendor", ("industry_40_initiative", "digital_transformation", "automation_keywords")),
)

# Drafts of offers in order: service, category, fit, signals that trigger it, confidence.
DRAFTS = (
    ("Manufacturing Analytics Platform", "data_visibility", "high", ("industry40_initiative", "iot_investment"), "high"),
    ("AI Agents / Operations Copilot", "process_automation", "high", ("ai_mention", "digital_transformation_hiring"), "high"),
    ("Cross-Plant Intelligence", "data_visibility", "high", ("multi_location_operations",), "high"),
    ("Predictive Maintenance AI", "maintenance", "high", ("capacity_expansion", "new_facility"), "medium"),
    ("Process Automation AI", "process_automation", "high", ("automation_investment", "automation_engineering_hiring"), "high"),
    ("Computer Vision Quality AI", "quality", "high", ("quality_certification_pursuit", "operations_hiring_surge"), "medium"),
    ("Supply Chain AI", "supply_chain", "medium", ("new_market_entry", "capacity_expansion"), "medium"),
    ("Operations Intelligence", "data_visibility", "high", ("mes_adoption", "erp_implementation"), "high"),
    ("Digital Twin Analytics", "data_visibility", "medium", ("industry40_initiative",), "medium"),
    ("Knowledge Intelligence AI", "process_automation", "medium", ("digital_transformation_hiring", "ai_ml_hiring"), "exploratory"),
)
FACTORY_ONLY = ("Manufacturing Analytics Platform", "Predictive Maintenance AI", "Computer Vision Quality AI", "Cross-Plant Intelligence")
MOST_DRAFTS = 5
