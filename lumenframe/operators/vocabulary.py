"""Word lists and maps of the annotation domain.

Fixed values: results are only right with these.
"""

PROGRAMS = {
    "NK cytotoxic": ["NKG7", "GNLY", "PRF1", "GZMB", "GZMH", "GZMA", "CST7", "FGFBP2", "KLRF1", "FCGR3A"],
    "NK tissue/regulatory/chemokine": ["XCL1", "XCL2", "KLRC1", "KLRC2", "KLRB1", "CXCR6", "ITGAE", "ZNF683", "CCL3", "CCL4", "CCL5"],
    "proliferation": ["MKI67", "TOP2A", "STMN1", "TYMS", "RRM2", "TK1", "PCNA", "PCLAF", "NUSAP1"],
    "interferon/cytokine": ["ISG15", "IFIT1", "IFIT2", "IFIT3", "IFI44L", "MX1", "STAT1", "IRF7", "IL2RA", "IL7R", "CCR7", "IRF4"],
    "T cell": ["CD3D", "CD3E", "CD3G", "TRAC", "TRBC1", "TRBC2", "TCF7", "SELL", "LEF1"],
    "B cell": ["MS4A1", "CD79A", "CD79B", "BANK1", "BLK", "FCRL1", "IGHM", "IGKC"],
    "myeloid": ["LYZ", "LST1", "S100A8", "S100A9", "C5AR1", "CLEC7A", "MS4A7", "MAFB"],
    "erythroid": ["HBB", "HBA1", "HBA2", "HBD", "HBM", "AHSP"],
    "lung/stromal-like": ["DOCK4", "SLC8A1", "FMN1", "PLXDC2", "SLC1A3", "NHSL1", "LHFPL2", "LRP1", "NRP1"],
}

REFINED_LABELS = [
    "Mature Cytotoxic",
    "Mature Cytotoxic TCF7+",
    "Lung Cytotoxic NK",
    "Lung DOCK4+ SLC8A1+ NK",
    "Transitional Cytotoxic Tissue-Resident",
    "Transitional Cytotoxic",
    "Cytokine-Stimulated CCR7+",
    "Cytokine-Stimulated Proliferative",
    "Proliferative",
    "Regulatory",
    "T",
    "B",
    "Unknown_Kidney",
    "Unknown_BM_1 Erythroid-like",
    "Myeloid-like",
]

#: Labels of groups that are no NK state.
OTHER_LINEAGES = ["T", "B", "Myeloid-like", "Unknown_BM_1 Erythroid-like", "Unknown_Kidney"]

DRAFT_OF_LABEL = {
    "B": "B",
    "T": "T",
    "Mature Cytotoxic": "Mature Cytotoxic",
    "Transitional Cytotoxic": "Transitional Cytotoxic",
    "Cytokine-Stimulated": "Cytokine-Stimulated review",
    "Proliferative": "Proliferative",
    "Regulatory": "Regulatory",
    "Unconventional": "Unconventional",
    "Unknown_Lung_6": "Lung Cytotoxic NK",
    "Unknown_Lung_5": "Lung DOCK4+ SLC8A1+ NK",
    "Unknown_Lung_4": "Unknown_Lung_4",
    "Unknown_Lung_3": "Unknown_Lung_3 review",
    "Unknown_Lung_1": "Unknown_Lung_1",
    "Unknown_Kidney": "Unknown_Kidney",
    "Unknown_BM_1": "Unknown_BM_1 Erythroid-like review",
    "Unknown_BM_2": "Unknown_BM_2",
    "Developmental": "Developmental review",
}

NOTE_WORDS = {
    "mixed_original_NK_State": "mixed original manual labels",
    "high_tissue_specificity": "mostly from one tissue",
    "high_assay_specificity": "mostly from one assay",
    "high_dataset_specificity": "mostly from one dataset",
}

BROAD_GENES = ["MALAT1", "B2M", "TMSB4X", "HBB"]
BROAD_PREFIXES = ["MT-", "RPS", "RPL", "HBA"]

#: Sentences of results.
MOVED = "Candidate label was not in the approved refined-label vocabulary and was moved to suggested_new_label."
PROPOSED = "The model proposed this label, but it is not in the approved refined-label vocabulary."
SUFFICIENT = "No new label suggested: the approved candidate label was judged sufficient after reviewing worksheet notes and/or pairwise evidence."
OTHER_NAME = "Alternative label suggested because the approved label may not fully capture the cluster biology."
NO_OTHER_NAME = "No alternative name suggested; approved candidate label is sufficient."
QUESTIONS = {
    "kept": "Does the marker evidence support keeping this manual label?",
    "lineage": "Does the non-NK/contamination-like marker evidence justify separating this from NK states?",
    "proliferation": "Does the proliferation program justify this refined functional-state label?",
    "tissue": "Does the tissue/chemokine marker program justify this refined NK state?",
    "flags": "Are the lineage-marker flags biological, ambient RNA, or possible doublets?",
    "refined": "Does the DE and curated marker evidence support this refinement from the manual label?",
}
