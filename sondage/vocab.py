"""Vocabulary tables of the questionnaire.

Everything in this module is a fixed value: titles, labels, codes and column
lists that must be spelled exactly so for results to be right.
"""

# ---------------------------------------------------------------- fixed values
# Question title -> column identifier.
QUESTIONS = {
    "Câți ani aveți?": "Age",
    "Care este statutul dumneavoastră familial?": "Family_Status",
    "Care este genul dumneavoastră?": "Gender",
    "În ce categorie se încadrează venitul dumneavoastră lunar?": "Income_Category",
    "Ce procent aproximativ din venit considerați că vă este suficient pentru nevoi esențiale (mâncare, chirie, transport)?": "Essential_Needs_Percentage",
    "Cum ați descrie atitudinea dumneavoastră față de gestionarea banilor?": "Financial_Attitude",
    "Planificați bugetul lunar înainte de cheltuieli?": "Budget_Planning",
    "Reușiți să economisiți bani lunar?": "Save_Money",
    "Ce anume vă împiedică să economisiți bani lunar?": "Savings_Obstacle",
    "Cât de frecvent faceți achiziții impulsive (neplanificate)?": "Impulse_Buying_Frequency",
    "Pe ce categorie sunt, de obicei, cheltuielile dumneavoastră impulsive?": "Impulse_Buying_Category",
    "Care este principalul motiv pentru cheltuielile impulsive?": "Impulse_Buying_Reason",
    "Ați folosit vreodată un credit sau o linie de împrumut?": "Credit_Usage",
    "Cum considerați nivelul actual al datoriilor dumneavoastră?": "Debt_Level",
    "Ați făcut investiții financiare până acum?": "Financial_Investments",
    "Cât de des analizați situația contului bancar (venituri și cheltuieli)?": "Bank_Account_Analysis_Frequency",
    "Cât timp utilizați, în general, următoarele tipuri de produse înainte de a le înlocui?   [Îmbrăcăminte]": "Product_Lifetime_Clothing",
    "Cât timp utilizați, în general, următoarele tipuri de produse înainte de a le înlocui?   [Gadget-uri și dispozitive tech (telefoane, laptopuri, tablete, console etc.)]": "Product_Lifetime_Tech",
    "Cât timp utilizați, în general, următoarele tipuri de produse înainte de a le înlocui?   [Electrocasnice (frigider, mașină de spălat etc.)]": "Product_Lifetime_Appliances",
    "Cât timp utilizați, în general, următoarele tipuri de produse înainte de a le înlocui?   [Autoturisme]": "Product_Lifetime_Cars",
    "Care este scopul principal al economiilor dumneavoastră?  \n  (Alegeți toate opțiunile care se aplică)": "Savings_Goal",
    "Cum distribuiți, în general, cheltuielile lunare?  \n(Maxim 3 categorii principale.)": "Expense_Distribution",
}

# Titles of the form's own timestamp column, lower case.
TIMESTAMP_TITLES = ("marcaj de timp", "timestamp")

# Whole-cell answers -> English, any column.
ANSWERS = {
    "Masculin": "Male",
    "Feminin": "Female",
    "Prefer să nu răspund": "Prefer not to say",
    "40-50": "41-50",
    "30-40": "31-40",
    "Necăsătorit/ă, fără copii": "Single, no children",
    "Necăsătorit/ă, cu copii": "Single, with children",
    "Într-o relație sau căsătorit/ă, cu copii.": "In a relationship/married with children",
    "Într-o relație (coabitare) sau căsătorit/ă, fără copii.": "In a relationship/married without children",
    "Într-o relație sau căsătorit/ă, fără copii.": "In a relationship/married without children",
    "Altul": "Another",
    "Încerc să găsesc un echilibru": "I try to find a balance",
    "Cheltuiesc mai mult decât câștig": "Spend more than I earn",
    "Sunt disciplinat/ă în economisire": "I am disciplined in saving",
    "Planific bugetul în detaliu": "Plan budget in detail",
    "Planific doar lucrurile esențiale": "Plan only essentials",
    "Nu planific deloc": "Don't plan at all",
    "Recompensă personală („merit acest lucru”)": "Self-reward",
    "Reduceri sau promoții": "Discounts or promotions",
    "Presiuni sociale („toți prietenii au acest lucru”)": "Social pressure",
    "Da, pentru cheltuieli neprevăzute dar inevitabile": "Yes, for unexpected expenses",
    "Inexistent": "Absent",
    "Scăzut": "Low",
    "Gestionabil": "Manageable",
    "Dificil de gestionat": "Difficult to manage",
    "Nu, dar sunt interesat/ă": "No, but interested",
    "Da, ocazional": "Yes, occasionally",
    "Da, regulat": "Yes, regularly",
    "Nu, nu sunt interesat/ă": "No, not interested",
    "Săptămânal": "Weekly",
    "Lunar": "Monthly",
    "Zilnic": "Daily",
    "Rar sau deloc": "Rarely or never",
    "Sub 6 luni": "<6 months",
    "Sub 50%": "<50%",
    "Peste 75%": ">75%",
    "6-12 luni": "6-12 months",
    "1-3 ani": "1-3 years",
    "3-5 ani": "3-5 years",
    "5-10 ani": "5-10 years",
    "10-15 ani": "10-15 years",
    "Peste 15 ani": ">15 years",
    "Sub 20": "<20",
    "Peste 50": ">50",
    "Nu am achizitionat": "Not purchased yet",
    "Uneori": "Sometimes",
    "Des": "Often",
    "Foarte rar": "Very rarely",
    "Da": "Yes",
    "Nu": "No",
    "12.000-16 000 RON": "12.000-16.000 RON",
    "8000-12.000 RON": "8.000-12.000 RON",
    "4000-8000 RON": "4.000-8.000 RON",
    "Peste 16.000 RON": ">16.000 RON",
    "Sub 4000 RON": "<4.000 RON",
}

# Answers that are translated in one column only.
COLUMN_ANSWERS = {
    "Impulse_Buying_Category": {
        "Alimentație": "Food",
        "Haine sau produse de îngrijire personală": "Clothing or personal care products",
        "Electronice sau gadget-uri": "Electronics or gadgets",
        "Divertisment și timp liber": "Entertainment",
        "Altceva": "Other",
    },
    "Impulse_Buying_Reason": {"Altceva": "Other"},
}

# Multi-choice answers: label -> option, per column.
CHOICES = {
    "Savings_Goal": {
        "Economii pentru achiziții majore (locuință, mașină)": "Major_Purchases",
        "Siguranță financiară pentru pensionare": "Retirement",
        "Fond de urgență": "Emergency_Fund",
        "Educația copiilor": "Child_Education",
        "Vacanțe sau cumpărături mari": "Vacation",
        "Altceva": "Other",
    },
    "Savings_Obstacle": {
        "Altceva": "Other",
        "Venitul este insuficient": "Insufficient_Income",
        "Alte cheltuieli urgente au prioritate": "Other_Expenses",
        "Nu consider economiile o prioritate": "Not_Priority",
    },
    "Expense_Distribution": {
        "Alimentație": "Food",
        "Locuință (chirie, utilități)": "Housing",
        "Transport": "Transport",
        "Divertisment și timp liber (iesiri cu prietenii, hobby-uri, excursii)": "Entertainment",
        "Sănătate (consultații medicale, medicamente, fizioterapie)": "Health",
        "Aspect personal (salon, cosmetice, haine, fitness)": "Personal_Care",
        "Cheltuieli generale pentru copii (îmbrăcăminte, activități extrașcolare)": "Child_Education",
        "Alte cheltuieli": "Other",
    },
    "Credit_Usage": {
        "Da, pentru cheltuieli esențiale (locuință, hrană)": "Essential_Needs",
        "Da, pentru cheltuieli mari (ex. vacanțe, electronice, autoturism, imobil etc.)": "Major_Purchases",
        "Da, pentru cheltuieli mari (ex. vacanțe, electronice)": "Major_Purchases",
        "Da, pentru cheltuieli neprevăzute dar inevitabile (ex. sănătate, reparații)": "Unexpected_Expenses",
        "Da, pentru nevoi personale (ex. evenimente speciale, educație)": "Personal_Needs",
        "Nu am folosit niciodată": "Never_Used",
    },
}

# Capital letters that start a new choice after ", " in a multi-choice cell.
CHOICE_CAPITALS = "A-ZĂÎȘȚÂ"

# Ordinal codes; anything else is 0.
ORDINALS = {
    "Impulse_Buying_Frequency": {"Very rarely": 1, "Rarely": 2, "Sometimes": 3, "Often": 4, "Very often": 5},
    "Debt_Level": {"Absent": 1, "Low": 2, "Manageable": 3, "Difficult to manage": 4},
    "Bank_Account_Analysis_Frequency": {"Rarely or never": 1, "Monthly": 2, "Weekly": 3, "Daily": 4},
}

# Binary codes; anything else is 0.
BINARIES = {
    "Gender": {"Female": 0, "Male": 1, "Prefer not to say": 0},
    "Save_Money": {"No": 0, "Yes": 1},
}

# Answers per nominal column, used as the declared one-hot vocabulary.
NOMINALS = {
    "Family_Status": [
        "Another",
        "In a relationship/married with children",
        "In a relationship/married without children",
        "Single, no children",
        "Single, with children",
    ],
    "Financial_Attitude": ["I am disciplined in saving", "I try to find a balance", "Spend more than I earn"],
    "Budget_Planning": ["Don't plan at all", "Plan budget in detail", "Plan only essentials"],
    "Impulse_Buying_Category": [
        "Clothing or personal care products",
        "Electronics or gadgets",
        "Entertainment",
        "Food",
        "Other",
    ],
    "Impulse_Buying_Reason": ["Discounts or promotions", "Other", "Self-reward", "Social pressure"],
    "Financial_Investments": ["No, but interested", "No, not interested", "Yes, occasionally", "Yes, regularly"],
}

# Two more nominal columns of the decoded-sheet encoder.
DECODED_NOMINALS = {
    "Gender": ["Female", "Male", "Prefer not to say"],
    "Save_Money": ["No", "Yes"],
}

LIFETIMES = [
    "Product_Lifetime_Clothing",
    "Product_Lifetime_Tech",
    "Product_Lifetime_Appliances",
    "Product_Lifetime_Cars",
]

SCALED = ["Age", "Income_Category", "Essential_Needs_Percentage"] + LIFETIMES

MULTI_COLUMNS = ["Savings_Goal", "Savings_Obstacle", "Expense_Distribution", "Credit_Usage"]

DECODED_ORDER = [
    "Age", "Family_Status", "Gender", "Income_Category", "Essential_Needs_Percentage",
    "Financial_Attitude", "Budget_Planning", "Save_Money", "Savings_Goal", "Savings_Obstacle",
    "Expense_Distribution", "Product_Lifetime_Clothing", "Product_Lifetime_Tech",
    "Product_Lifetime_Appliances", "Product_Lifetime_Cars", "Impulse_Buying_Frequency",
    "Impulse_Buying_Category", "Impulse_Buying_Reason", "Credit_Usage", "Debt_Level",
    "Financial_Investments", "Bank_Account_Analysis_Frequency", "Behavior_Risk_Level",
]

# Months per time unit; an unknown unit counts as months.
MONTHS_PER_UNIT = {"months": 1, "month": 1, "years": 12, "year": 12, "ani": 12, "an": 12, "luni": 1}

# Weights of the linear risk score.
RISK_WEIGHTS = {
    "Debt_Level": 0.25,
    "Impulse_Buying_Frequency": 0.15,
    "Essential_Needs_Percentage": -0.2,
    "Savings_Goal_Emergency_Fund": 0.1,
    "Bank_Account_Analysis_Frequency": -0.1,
}

# Helper columns of the labelling run that are not features.
AUXILIARY = ["Confidence", "Cluster", "Auto_Label", "Outlier"]
EXCLUDED = ["Risk_Score", "Confidence", "Outlier", "Cluster", "Auto_Label"]
TARGET = "Behavior_Risk_Level"

# Columns that the evaluation flow fills when values are missing.
REQUIRED = [
    "Age", "Essential_Needs_Percentage", "Expense_Distribution_Entertainment",
    "Debt_Level", "Save_Money_Yes", "Behavior_Risk_Level",
]

# Continuous factors and flags of the evaluation figures.
RISK_FACTORS = ["Age", "Income_Category", "Essential_Needs_Percentage", "Debt_Level"] + LIFETIMES
HEATMAP_FLAGS = [
    "Credit_Usage_Never_Used",
    "Budget_Planning_Plan only essentials",
    "Impulse_Buying_Category_Entertainment",
    "Family_Status_In a relationship/married with children",
    "Savings_Goal_Emergency_Fund",
    "Financial_Investments_Yes, occasionally",
    "Savings_Goal_Retirement",
]

# Column groups of the exploration flow: exact names and name prefixes.
GROUPS = {
    "demographic": (["Age", "Gender", "Income_Category"], []),
    "expenses": ([], ["Expense_Distribution_"]),
    "economy": ([], ["Savings_Goal_", "Savings_Obstacle_"]),
    "credit": (["Debt_Level", "Bank_Account_Analysis_Frequency"], ["Credit_Usage_"]),
    "behaviors": ([], ["Financial_Attitude_", "Budget_Planning_"]),
    "impulsivity": ([], ["Impulse_Buying_"]),
    "investments": ([], ["Financial_Investments_"]),
}

# Flag blocks of the row constraints, in choice order.
GOAL_FLAGS = [
    "Savings_Goal_Emergency_Fund", "Savings_Goal_Major_Purchases", "Savings_Goal_Child_Education",
    "Savings_Goal_Vacation", "Savings_Goal_Retirement", "Savings_Goal_Other",
]
OBSTACLE_FLAGS = [
    "Savings_Obstacle_Insufficient_Income", "Savings_Obstacle_Other_Expenses",
    "Savings_Obstacle_Not_Priority", "Savings_Obstacle_Other",
]
EXPENSE_FLAGS = [
    "Expense_Distribution_Food", "Expense_Distribution_Housing", "Expense_Distribution_Transport",
    "Expense_Distribution_Entertainment", "Expense_Distribution_Health",
    "Expense_Distribution_Personal_Care", "Expense_Distribution_Child_Education",
    "Expense_Distribution_Other",
]
CREDIT_FLAGS = [
    "Credit_Essential_Needs", "Credit_Major_Purchases", "Credit_Unexpected_Expenses",
    "Credit_Personal_Needs", "Credit_Never_Used",
]

# Allowed answers of the row constraints; the first is the default.
ALLOWED = {
    "Family_Status": [
        "Single, no children",
        "In a relationship/married without children",
        "In a relationship/married with children",
    ],
    "Financial_Attitude": ["I try to find a balance", "I am disciplined in saving"],
    "Impulse_Buying_Reason": ["Self-reward", "Discounts or promotions"],
}
DEBT_FREE_INVESTMENTS = ["Yes, occasionally", "No, but interested"]

# Numeric columns of a generated table that are cleaned to integers.
GENERATED_NUMERIC = ["Age", "Income_Category", "Essential_Needs_Percentage"] + EXPENSE_FLAGS

# Column order of the deprecated generated table.
GENERATED_ORDER = [
    "Age", "Family_Status", "Gender", "Income_Category", "Essential_Needs_Percentage",
    "Financial_Attitude", "Budget_Planning", "Save_Money",
] + LIFETIMES + [
    "Impulse_Buying_Frequency", "Impulse_Buying_Category", "Impulse_Buying_Reason",
    "Debt_Level", "Financial_Investments", "Bank_Account_Analysis_Frequency",
] + GOAL_FLAGS + OBSTACLE_FLAGS + EXPENSE_FLAGS + CREDIT_FLAGS + ["Behavior_Risk_Level"]
