"""Fixed values of the scoring funnel.  Order matters where ties go to the first entry."""

# fixed values: watched brands, in tie-breaking order
WATCHED_BRANDS = (
    "microsoft", "office365", "google", "paypal", "apple", "amazon", "docusign", "dropbox",
    "chase", "wellsfargo", "bankofamerica", "linkedin", "adobe", "netflix", "zoom", "okta",
)

# fixed values: characters that are read as another one in domain labels
CONFUSABLE_FROM = "0135@аеорсуіѕԁɡ"
CONFUSABLE_TO = "oiesaaeopcyisdg"

# fixed values: urgency keywords, in reporting order
URGENCY_KEYWORDS = (
    "urgent", "immediately", "action required", "verify your account", "suspended", "locked",
    "unauthorized", "expire", "final notice", "click here", "confirm your identity", "unusual activity",
)

# fixed values: free mail providers (informational, never scored)
FREEMAIL_DOMAINS = ("gmail.com", "yahoo.com", "outlook.com", "hotmail.com", "aol.com", "icloud.com", "protonmail.com", "mail.com")

# fixed values: corpus labels
LABELS = {0: "ham", 1: "phishing", 2: "ai_phish"}
BINARY_LABELS = {0: "legit", 1: "phish"}

# fixed values: points of the infrastructure score
POINTS = {
    "dmarc_fail": 30, "dmarc_none": 8, "spf_fail": 20, "dkim_fail": 15, "lookalike": 25, "display": 20,
    "reply_to": 12, "links": 15, "urgency_each": 3, "urgency_most": 10, "young_domain": 15,
}
LOOKALIKE_SCORED_FROM = 0.8
YOUNG_DOMAIN_DAYS = 30

# fixed values: verdict bounds
ESCALATE_FROM, REVIEW_FROM = 40, 15
PHISHING_FROM, SUSPICIOUS_FROM = 60, 30

# fixed values: attribution vocabulary
OBJECTIVES = ("Credential Harvesting", "Malware Delivery", "Wire Transfer Fraud", "Data Exfiltration", "Reconnaissance", "Other")
TRIGGERS = ("Authority", "Urgency", "Fear", "Curiosity", "Greed", "Trust", "Scarcity", "Social Proof")
SOPHISTICATION = ("Low", "Medium", "High")

#: What Python's str.strip removes, as a regex class that Java and RE2 read alike.
BLANKS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
