"""Words in column names and in values that speak for a domain, with the domain's weight.

Callers may pass their own table of the same form to detect_domain.
"""

DOMAINS = {
    "E-commerce / Retail Transaction": (
        ("product", "price", "order", "cart", "sku", "quantity", "discount", "shipping", "customer", "invoice", "item",
         "purchase", "payment"),
        ("shipped", "delivered", "pending", "refund", "credit card"), 1.0),
    "Financial / Banking": (
        ("account", "balance", "transaction", "debit", "credit", "interest", "loan", "mortgage", "deposit", "withdrawal",
         "portfolio", "stock", "dividend", "forex", "exchange_rate"),
        ("savings", "checking", "wire transfer", "ach"), 1.0),
    "Healthcare / Medical": (
        ("patient", "diagnosis", "symptom", "medication", "dosage", "hospital", "doctor", "icd", "blood", "heart_rate",
         "bmi", "cholesterol", "prescription", "treatment", "vitals"),
        ("mg", "tablet", "injection", "outpatient", "inpatient"), 1.0),
    "Human Resources / Employee": (
        ("employee", "salary", "department", "hire_date", "position", "manager", "performance", "leave", "attendance",
         "bonus", "designation", "experience", "qualification"),
        ("full-time", "part-time", "contract", "terminated", "active"), 1.0),
    "Marketing / Customer Analytics": (
        ("campaign", "click", "impression", "conversion", "bounce", "session", "referrer", "utm", "channel", "engagement",
         "ctr", "cpc", "roi", "lead", "funnel"),
        ("organic", "paid", "social", "email campaign"), 1.0),
    "Logistics / Supply Chain": (
        ("warehouse", "shipment", "tracking", "carrier", "freight", "inventory", "supply", "vendor", "supplier",
         "delivery", "route", "fleet"),
        ("in transit", "delivered", "out for delivery"), 1.0),
    "Education / Academic": (
        ("student", "grade", "course", "enrollment", "gpa", "semester", "professor", "faculty", "exam", "score",
         "assignment", "class"),
        ("freshman", "sophomore", "junior", "senior", "graduate"), 1.0),
    "IoT / Sensor Data": (
        ("sensor", "device_id", "temperature", "humidity", "pressure", "acceleration", "voltage", "current", "signal",
         "beacon", "reading", "measurement"),
        (), 0.9),
    "Social Media / User Activity": (
        ("user", "post", "like", "comment", "share", "follower", "following", "tweet", "hashtag", "mention", "profile",
         "feed", "story"),
        (), 0.9),
    "Real Estate / Property": (
        ("property", "bedroom", "bathroom", "sqft", "square_feet", "lot_size", "listing", "rent", "mortgage",
         "appraisal", "zoning", "address"),
        ("residential", "commercial", "condo", "townhouse"), 1.0),
    "Survey / Questionnaire": (
        ("respondent", "response", "answer", "question", "survey", "rating", "satisfaction", "feedback", "likert",
         "agree", "disagree"),
        ("strongly agree", "agree", "neutral", "disagree", "strongly disagree"), 1.0),
}
