"""Word lists and labels that rules refer to. All are fixed values, in their order of precedence."""

# Language rules: words in any letter case, or letters of a script. Earlier rules win.
LANGUAGE_WORDS = (
    ("pt", ("obrigad[oa]", r"boa\s+noite", r"bom\s+dia", r"boa\s+tarde", r"por\s+favor", "não", "voce", "você", "está", "estou", "pedido", "entrega", "pagamento", "conta", "reembolso", "cancelamento", "cobrança", "fatura")),
    ("es", ("gracias", r"por\s+favor", "buenos", "buenas", "hola", "estoy", "tengo", "necesito", "pedido", "envío", "pago", "devolución", "cancelar", "cuenta", "tarjeta", "problema")),
    ("fr", ("merci", "bonjour", "bonsoir", r"s'il\s+vous\s+plaît", r"je\s+suis", r"je\s+voudrais", "commande", "livraison", "remboursement", "annulation", "compte", "problème", "paiement")),
    ("de", ("danke", "bitte", r"guten\s+(?:tag|morgen|abend)", r"ich\s+habe", "bestellung", "lieferung", "zahlung", "rückerstattung", "konto", "problem", "fehler")),
)
LANGUAGE_SCRIPTS = (("ja", "\u3040", "\u30ff"), ("zh", "\u4e00", "\u9fff"), ("ko", "\uac00", "\ud7af"), ("ar", "\u0600", "\u06ff"), ("hi", "\u0900", "\u097f"), ("ru", "\u0400", "\u04ff"))

# Sentiment, fast form.
NEGATIVE_STEMS = ("crash", "error", "fail", "bad", "worst", "cancel", "slow", "down", "broken", "problem", "horrible", "issue", "refund", "unstable", "hate", "terrible", "sucks", "delay", "stuck", "fix", "wrong", "locked")
POSITIVE_STEMS = ("great", "good", "thanks", "thank", "awesome", "fixed", "love", "happy", "resolved", "best", "excellent", "amazing", "perfect", "helpful", "working", "appreciate")

# Sentiment, voting form.
NEGATIVE_VOTES = ("crash", "angry", "bad", "complain", "problem", "issue", "refund", "unstable", "down", "charge")
POSITIVE_VOTES = ("great", "resolved", "helpful", "thanks", "praise", "fixed", "love")

# Topic domains: id, keywords, stems.
TOPIC_DOMAINS = (
    (0, "crash, freeze, bug, glitch", ("crash", "freez", "stop", "clos", "force", "lag", "hang", "glitch", "bug", "error", "erro", "falha", "travou", "bugado")),
    (1, "delivery, order, tracking, delay", ("delivery", "deliver", "order", "package", "track", "shipment", "shipping", "transit", "delay", "baggage", "luggage", "entrega", "pedido", "encomenda", "atraso", "rastreio", "rastrear", "receber", "prazo")),
    (2, "billing, charge, invoice, payment", ("billing", "bill", "refund", "charge", "invoice", "payment", "card", "cost", "price", "overcharge", "wallet", "subscription", "pagamento", "fatura", "cobrança", "preco", "cartao", "promocao", "promoo")),
    (3, "login, password, auth, 2fa", ("login", "password", "sign", "account", "auth", "reset", "email", "code", "otp", "2fa", "lock", "verify", "senha", "conta", "acesso", "entrar")),
    (4, "refund, cancel, dispute, return", ("refund", "cancel", "dispute", "return", "reimburse", "money back", "claim", "reembolso", "cancelamento", "devolucao", "estorno")),
    (5, "battery, power, drain, overheat", ("battery", "power", "drain", "heat", "overheat", "screen", "display", "touch", "charge", "hardware", "bateria", "tela")),
)
OTHER_TOPIC = (6, "thanks, help, assist, inquiry")

# Cluster titles by keyword.
CLUSTER_TITLES = (
    ("App Crashes & System Stability", ("crash", "freez", "bug", "glitch", "error", "stability")),
    ("Delivery, Order Tracking & Delays", ("delivery", "order", "track", "shipment", "transit", "delay", "baggage")),
    ("Billing, Invoices & Payment Inquiries", ("bill", "charge", "invoice", "payment", "fee", "cost", "wallet")),
    ("Account Access & Password Authentication", ("login", "password", "auth", "2fa", "lock", "access", "account")),
    ("Refunds, Cancellations & Dispute Resolution", ("refund", "cancel", "dispute", "return", "claim")),
    ("Hardware & Battery Health Performance", ("battery", "power", "drain", "heat", "hardware")),
    ("Software Updates & OS Compatibility", ("update", "ios", "version", "install", "upgrade")),
    ("Network Connectivity & Coverage", ("network", "wifi", "internet", "signal", "5g", "data")),
    ("General Support & Conversational Inquiries", ("unclassified", "unspecified", "pending", "general", "inquiry")),
    ("Customer Service Praise & Quick Help", ("thanks", "thank", "help", "great", "solved", "dm", "praise")),
)
CLUSTER_STOPWORDS = (
    "dm", "help", "thanks", "thank", "sorry", "hi", "hello", "hey", "please", "time", "que", "im", "ive", "amazon", "apple", "applesupport", "amazonhelp", "ubersupport", "spotifycares", "support", "team", "service",
    "customer", "reach", "contact", "assist", "para", "uma", "com", "por", "favor", "voc", "seu", "sua", "ter", "estar", "danke", "info", "hast", "schon", "mal", "einen", "lieben", "gru", "gracias", "hice", "dijeron",
    "espere", "llegue", "justo", "molestia", "link", "details", "check", "message", "private", "can", "cant", "could", "would", "know", "let", "us", "got", "get", "see", "look", "make", "need", "want", "try", "like",
    "just", "still", "now", "today", "day", "days", "way", "send", "sent", "reply", "respond", "number", "store", "good", "evening", "morning", "afternoon", "yes", "no", "ok", "okay", "great", "awesome",
)

# Departments by cluster title, then by keyword.
DEPARTMENT_OF_TITLE = (
    ("App Crashes & System Stability", "Engineering & Platform Stability"),
    ("Delivery, Order Tracking & Delays", "Product & Logistics Fulfillment"),
    ("Billing, Invoices & Payment Inquiries", "Billing, Revenue & Subscription"),
    ("Account Access & Password Authentication", "Account & Information Security"),
    ("Refunds, Cancellations & Dispute Resolution", "Finance & Customer Disputes"),
    ("Hardware & Battery Health Performance", "Hardware & Device Diagnostics"),
    ("Software Updates & OS Compatibility", "Mobile & OS Engineering"),
    ("Network Connectivity & Coverage", "Network & Infrastructure Ops"),
    ("General Support & Conversational Inquiries", "Customer Support & Frontline Triage"),
    ("Customer Service Praise & Quick Help", "Voice-of-Customer & Quality Assurance"),
)
DEPARTMENT_OF_WORD = (
    ("Billing, Revenue & Subscription", ("bill", "payment", "invoice", "refund", "charge", "card")),
    ("Product & Logistics Fulfillment", ("delivery", "order", "shipping", "transit", "package")),
    ("Account & Information Security", ("auth", "login", "password", "security", "account", "2fa")),
    ("Engineering & Platform Stability", ("crash", "bug", "freeze", "error", "update", "software", "ios")),
    ("Hardware & Device Diagnostics", ("battery", "power", "heat", "hardware", "device")),
)
OTHER_DEPARTMENT = "Customer Support & Frontline Triage"

# Issue categories and their subcategories. A phrase counts twice in a category.
ISSUE_CATEGORIES = (
    ("Network", ("network", "internet", "connection", "connectivity", "signal", "wifi", "disconnect", "disconnected", "outage", "slow")),
    ("Billing", ("bill", "billing", "charged", "charge", "invoice", "overcharged", "double charged", "charged twice")),
    ("Payment", ("payment", "pay", "paid", "refund", "transaction", "card")),
    ("Account", ("account", "profile", "account access")),
    ("Login", ("login", "log in", "sign in", "password", "forgot password", "reset password")),
    ("Mobile Data", ("mobile data", "data not working", "data connection", "4g", "5g", "data usage")),
    ("Calls", ("call", "calling", "phone call", "dropped call", "call drop")),
    ("SMS", ("sms", "text message", "messages not sending")),
    ("App / Technical", ("app", "application", "crash", "crashing", "error", "bug", "technical", "notification")),
    ("Device", ("phone", "mobile", "device", "iphone", "android", "handset")),
    ("Plan / Subscription", ("plan", "subscription", "recharge", "package", "upgrade", "downgrade", "renewal")),
    ("Customer Service", ("support", "customer service", "agent", "representative", "help", "complaint")),
)
ISSUE_SUBCATEGORIES = {
    "Network": (("No Internet", ("not working", "no internet", "internet is down", "stopped working")), ("Slow Internet", ("slow", "extremely slow")), ("Connection Drop", ("disconnect", "disconnecting", "dropped")), ("Network Outage", ("outage", "network down"))),
    "Billing": (("Duplicate Charge", ("charged twice", "charged two times", "double charged")), ("Incorrect Bill", ("incorrect bill", "wrong bill", "billing error")), ("Overcharge", ("overcharged", "extra charge"))),
    "Login": (("Password Problem", ("password", "reset password")), ("Login Failure", ("cannot login", "can't login", "unable to login", "cannot access"))),
    "Mobile Data": (("Data Not Working", ("data not working", "mobile data not working")), ("Data Speed", ("slow data",))),
}

# Relabelling in six steps: label, pain point, stems.
RELABEL_STEPS = (
    ("Billing, Invoices & Payment Inquiries", "Unexpected charge or payment invoice issue", ("bill", "invoice", "charge", "payment", "tax", "fee", "credit card", "wallet", "overcharge", "cost")),
    ("Delivery, Order Tracking & Delays", "Delivery delay past guaranteed date", ("delivery", "deliver", "order", "package", "track", "shipment", "shipping", "luggage", "baggage", "transit")),
    ("Account Access & Password Authentication", "Unable to log in after two-factor authentication failed", ("login", "password", "access", "account", "2fa", "authenticate", "auth", "lock", "verify", "profile")),
    ("Application Crashes & Technical Malfunction", "App crashes or freeze after software upgrade", ("app", "crash", "bug", "update", "error", "load", "freeze", "glitch", "software", "ios", "android")),
    ("Refunds, Cancellations & Dispute Resolution", "Disputed cancellation and delayed refund credit", ("refund", "cancel", "dispute", "return", "money back", "claim")),
)
RELABEL_REST = ("Customer Service Praise & Quick Help", "Standard service inquiry resolved by agent")
PENDING_TOPIC = "Pending AI Discovery"

# Intents as whole words.
INTENTS = (
    ("billing", ("bill", "invoice", "charge", "payment")),
    ("login", ("login", "password", "sign in", "account access")),
    ("refund", ("refund", "return", "money back")),
    ("delivery", ("delivery", "shipment", "late", "package")),
    ("technical_issue", ("crash", "crashing", "bug", "error", "broken", "unstable")),
    ("cancellation", ("cancel", "subscription")),
    ("account_issue", ("account", "profile", "locked")),
)

# Context labels of the conversational layer.
CONTEXT_NEGATIVE = ("crash", "angry", "bad", "complain", "problem", "issue", "refund")
CONTEXT_POSITIVE = ("great", "resolved", "helpful", "thanks")

# Words that turn a shown sentiment negative.
STRONG_NEGATIVE = (
    "suck", "sucks", "terrible", "awful", "horrible", "worst", "broken", "angry", "hate", "fail", "failed", "useless", "scam", "trash", "garbage", "poor", "delayed", "delay",
    "not received", "hasnt", "hasn't", "never received", "wrong information", "false promise", "stole", "stolen", "lost", "missing", "refund", "charged", "overcharged", "shameful",
)

GENERIC_TOPICS = ("general support", "general", "other", "unclassified", "pending ai discovery", "general support, inquiries", "unspecified support friction", "unclassified customer issue")
URGENT = ("high", "urgent", "critical")
TRUE_WORDS = ("true", "1", "yes", "y", "resolved", "closed")
RESOLVED_STATUSES = ("resolved", "closed", "complete", "completed", "solved")
