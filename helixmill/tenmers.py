"""Scored 10-mers. Nothing here is logic; the values are stated plainly."""

# fixed values: Z-DNA 10-mers and their scores
Z_DNA = {
    "AACGCGCGCG": 50.25,
    "ATGCGCGCGC": 51.25,
    "ATCGCGCGCG": 50.0,
    "AGCGCGCGCA": 50.25,
    "AGCGCGCGCG": 56.0,
    "ACGGCGCGCG": 50.25,
    "ACGCGGCGCG": 50.25,
    "ACGCGCGGCG": 50.25,
    "ACGCGCGCGA": 50.25,
    "ACGCGCGCGT": 51.5,
    "ACGCGCGCGG": 50.25,
    "ACGCGCGCGC": 57.25,
    "ACGCGCGCCG": 50.25,
    "ACGCGCCGCG": 50.25,
    "ACGCCGCGCG": 50.25,
    "ACCGCGCGCG": 50.25,
    "TAGCGCGCGC": 50.0,
    "TACGCGCGCG": 51.25,
    "TTGCGCGCGC": 50.25,
    "TGGCGCGCGC": 50.25,
    "TGCGGCGCGC": 50.25,
    "TGCGCGGCGC": 50.25,
    "TGCGCGCGGC": 50.25,
    "TGCGCGCGCA": 51.5,
    "TGCGCGCGCT": 50.25,
    "TGCGCGCGCG": 57.25,
    "TGCGCGCGCC": 50.25,
    "TGCGCGCCGC": 50.25,
    "TGCGCCGCGC": 50.25,
    "TGCCGCGCGC": 50.25,
    "TCGCGCGCGT": 50.25,
    "TCGCGCGCGC": 56.0,
    "GACGCGCGCG": 50.25,
    "GTGCGCGCGC": 51.5,
    "GTCGCGCGCG": 50.25,
    "GGCGCGCGCA": 50.25,
    "GGCGCGCGCG": 56.0,
    "GCAGCGCGCG": 50.25,
    "GCACGCGCGC": 51.5,
    "GCTGCGCGCG": 50.25,
    "GCGACGCGCG": 50.25,
    "GCGTGCGCGC": 51.5,
    "GCGTCGCGCG": 50.25,
    "GCGGCGCGCA": 50.25,
    "GCGGCGCGCG": 56.0,
    "GCGCAGCGCG": 50.25,
    "GCGCACGCGC": 51.5,
    "GCGCTGCGCG": 50.25,
    "GCGCGACGCG": 50.25,
    "GCGCGTGCGC": 51.5,
    "GCGCGTCGCG": 50.25,
    "GCGCGGCGCA": 50.25,
    "GCGCGGCGCG": 56.0,
    "GCGCGCAGCG": 50.25,
    "GCGCGCACGC": 51.5,
    "GCGCGCTGCG": 50.25,
    "GCGCGCGACG": 50.25,
    "GCGCGCGTGC": 51.5,
    "GCGCGCGTCG": 50.25,
    "GCGCGCGGCA": 50.25,
    "GCGCGCGGCG": 56.0,
    "GCGCGCGCAA": 50.25,
    "GCGCGCGCAT": 51.25,
    "GCGCGCGCAG": 50.25,
    "GCGCGCGCAC": 51.5,
    "GCGCGCGCTA": 50.0,
    "GCGCGCGCTG": 50.25,
    "GCGCGCGCGA": 56.0,
    "GCGCGCGCGT": 57.25,
    "GCGCGCGCGG": 56.0,
    "GCGCGCGCGC": 63.0,
    "GCGCGCGCCA": 50.25,
    "GCGCGCGCCG": 56.0,
    "GCGCGCCGCA": 50.25,
    "GCGCGCCGCG": 56.0,
    "GCGCCGCGCA": 50.25,
    "GCGCCGCGCG": 56.0,
    "GCCGCGCGCA": 50.25,
    "GCCGCGCGCG": 56.0,
    "CAGCGCGCGC": 50.25,
    "CACGCGCGCG": 51.5,
    "CTGCGCGCGC": 50.25,
    "CGACGCGCGC": 50.25,
    "CGTGCGCGCG": 51.5,
    "CGTCGCGCGC": 50.25,
    "CGGCGCGCGT": 50.25,
    "CGGCGCGCGC": 56.0,
    "CGCAGCGCGC": 50.25,
    "CGCACGCGCG": 51.5,
    "CGCTGCGCGC": 50.25,
    "CGCGACGCGC": 50.25,
    "CGCGTGCGCG": 51.5,
    "CGCGTCGCGC": 50.25,
    "CGCGGCGCGT": 50.25,
    "CGCGGCGCGC": 56.0,
    "CGCGCAGCGC": 50.25,
    "CGCGCACGCG": 51.5,
    "CGCGCTGCGC": 50.25,
    "CGCGCGACGC": 50.25,
    "CGCGCGTGCG": 51.5,
    "CGCGCGTCGC": 50.25,
    "CGCGCGGCGT": 50.25,
    "CGCGCGGCGC": 56.0,
    "CGCGCGCAGC": 50.25,
    "CGCGCGCACG": 51.5,
    "CGCGCGCTGC": 50.25,
    "CGCGCGCGAT": 50.0,
    "CGCGCGCGAC": 50.25,
    "CGCGCGCGTA": 51.25,
    "CGCGCGCGTT": 50.25,
    "CGCGCGCGTG": 51.5,
    "CGCGCGCGTC": 50.25,
    "CGCGCGCGGT": 50.25,
    "CGCGCGCGGC": 56.0,
    "CGCGCGCGCA": 57.25,
    "CGCGCGCGCT": 56.0,
    "CGCGCGCGCG": 63.0,
    "CGCGCGCGCC": 56.0,
    "CGCGCGCCGT": 50.25,
    "CGCGCGCCGC": 56.0,
    "CGCGCCGCGT": 50.25,
    "CGCGCCGCGC": 56.0,
    "CGCCGCGCGT": 50.25,
    "CGCCGCGCGC": 56.0,
    "CCGCGCGCGT": 50.25,
    "CCGCGCGCGC": 56.0,
}

# fixed values: A-philic 10-mers and their mean log2 odds
A_PHILIC = {
    "AGGGGGGGGG": 2.702428571428571,
    "CCCCCCCCCT": 2.702428571428571,
    "AGGGGGGGGC": 2.683285714285714,
    "GCCCCCCCCT": 2.683285714285714,
    "CCCCCCCCTA": 2.5665571428571425,
    "TAGGGGGGGG": 2.5665571428571425,
    "GCCCCCCCTA": 2.5474142857142854,
    "TAGGGGGGGC": 2.5474142857142854,
    "ACCCCCCCCT": 2.4612714285714286,
    "AGGGGGGGGT": 2.4612714285714286,
    "AGGGCCCCCT": 2.487357142857143,
    "AGGGGCCCCT": 2.487357142857143,
    "AGGGGGCCCT": 2.487357142857143,
    "ACCCCCCCTA": 2.3253999999999997,
    "TAGGGGGGGT": 2.3253999999999997,
    "ACCCCCCCCC": 2.294942857142857,
    "GGGGGGGGGT": 2.294942857142857,
    "CCCCCCCCCG": 2.294942857142857,
    "CGGGGGGGGG": 2.294942857142857,
    "AGGGCCCCTA": 2.3514857142857144,
    "AGGGGCCCTA": 2.3514857142857144,
    "TAGGGCCCCT": 2.3514857142857144,
    "TAGGGGCCCT": 2.3514857142857144,
    "AGGGGGGGCC": 2.3401714285714283,
    "GGCCCCCCCT": 2.3401714285714283,
    "CGGGGGGGGC": 2.2758,
    "GCCCCCCCCG": 2.2758,
    "ACCCCCCCCA": 2.2284142857142855,
    "TGGGGGGGGT": 2.2284142857142855,
    "AGGGCCCCCC": 2.321028571428571,
    "AGGGGCCCCC": 2.321028571428571,
    "AGGGGGCCCC": 2.321028571428571,
    "AGGGGGGCCC": 2.321028571428571,
    "GGGCCCCCCT": 2.321028571428571,
    "GGGGCCCCCT": 2.321028571428571,
    "GGGGGCCCCT": 2.321028571428571,
    "GGGGGGCCCT": 2.321028571428571,
    "AGGGCCCCCA": 2.2544999999999997,
    "AGGGGCCCCA": 2.2544999999999997,
    "AGGGGGCCCA": 2.2544999999999997,
    "TGGGCCCCCT": 2.2544999999999997,
    "TGGGGCCCCT": 2.2544999999999997,
    "TGGGGGCCCT": 2.2544999999999997,
    "TAGGGCCCTA": 2.2156142857142855,
    "GGGCCCCCTA": 2.185157142857143,
    "GGGGCCCCTA": 2.185157142857143,
    "GGGGGCCCTA": 2.185157142857143,
    "TAGGGCCCCC": 2.185157142857143,
    "TAGGGGCCCC": 2.185157142857143,
    "TAGGGGGCCC": 2.185157142857143,
    "GGCCCCCCCC": 2.173842857142857,
    "GGGGGGGGCC": 2.173842857142857,
    "GGGCCCCCCC": 2.1546999999999996,
    "GGGGCCCCCC": 2.1546999999999996,
    "GGGGGCCCCC": 2.1546999999999996,
    "GGGGGGCCCC": 2.1546999999999996,
    "GGGGGGGCCC": 2.1546999999999996,
    "TAGGGCCCCA": 2.1186285714285713,
    "TAGGGGCCCA": 2.1186285714285713,
    "TGGGCCCCTA": 2.1186285714285713,
    "TGGGGCCCTA": 2.1186285714285713,
    "GGCCCCCCCA": 2.1073142857142857,
    "TGGGGGGGCC": 2.1073142857142857,
    "GGGCCCCCCA": 2.0881714285714286,
    "GGGGCCCCCA": 2.0881714285714286,
    "GGGGGCCCCA": 2.0881714285714286,
    "GGGGGGCCCA": 2.0881714285714286,
    "TGGGCCCCCC": 2.0881714285714286,
    "TGGGGCCCCC": 2.0881714285714286,
    "TGGGGGCCCC": 2.0881714285714286,
    "TGGGGGGCCC": 2.0881714285714286,
    "ACCCCCCCCG": 2.053785714285714,
    "CGGGGGGGGT": 2.053785714285714,
    "TGGGCCCCCA": 2.021642857142857,
    "TGGGGCCCCA": 2.021642857142857,
    "TGGGGGCCCA": 2.021642857142857,
    "AGGGCCCCCG": 2.0798714285714284,
    "AGGGGCCCCG": 2.0798714285714284,
    "AGGGGGCCCG": 2.0798714285714284,
    "CGGGCCCCCT": 2.0798714285714284,
    "CGGGGCCCCT": 2.0798714285714284,
    "CGGGGGCCCT": 2.0798714285714284,
    "CCCCCCCCGG": 1.9696571428571428,
    "CCGGGGGGGG": 1.9696571428571428,
    "CCGGGGGGGC": 1.9505142857142856,
    "GCCCCCCCGG": 1.9505142857142856,
    "CGGGCCCCTA": 1.9440000000000002,
    "CGGGGCCCTA": 1.9440000000000002,
    "TAGGGCCCCG": 1.9440000000000002,
    "TAGGGGCCCG": 1.9440000000000002,
    "CGGGGGGGCC": 1.9326857142857141,
    "GGCCCCCCCG": 1.9326857142857141,
    "CGGGCCCCCC": 1.9135428571428572,
    "CGGGGCCCCC": 1.9135428571428572,
    "CGGGGGCCCC": 1.9135428571428572,
    "CGGGGGGCCC": 1.9135428571428572,
    "GGGCCCCCCG": 1.9135428571428572,
    "GGGGCCCCCG": 1.9135428571428572,
    "GGGGGCCCCG": 1.9135428571428572,
    "GGGGGGCCCG": 1.9135428571428572,
    "CGGGCCCCCA": 1.8470142857142857,
    "CGGGGCCCCA": 1.8470142857142857,
    "CGGGGGCCCA": 1.8470142857142857,
    "TGGGCCCCCG": 1.8470142857142857,
    "TGGGGCCCCG": 1.8470142857142857,
    "TGGGGGCCCG": 1.8470142857142857,
    "ACCCCCCCGG": 1.7285,
    "CCGGGGGGGT": 1.7285,
    "CCCCCCCGGG": 1.7285,
    "CCCCCCGGGG": 1.7285,
    "CCCCCGGGGG": 1.7285,
    "CCCCGGGGGG": 1.7285,
    "CCCGGGGGGG": 1.7285,
    "CCCCCCGGGC": 1.7093571428571426,
    "CCCCCGGGGC": 1.7093571428571426,
    "CCCCGGGGGC": 1.7093571428571426,
    "CCCGGGGGGC": 1.7093571428571426,
    "GCCCCCCGGG": 1.7093571428571426,
    "GCCCCCGGGG": 1.7093571428571426,
    "GCCCCGGGGG": 1.7093571428571426,
    "GCCCGGGGGG": 1.7093571428571426,
    "AGGGCCCCGG": 1.7545857142857142,
    "AGGGGCCCGG": 1.7545857142857142,
    "CCGGGCCCCT": 1.7545857142857142,
    "CCGGGGCCCT": 1.7545857142857142,
    "GCCCCCGGGC": 1.6902142857142857,
    "GCCCCGGGGC": 1.6902142857142857,
    "GCCCGGGGGC": 1.6902142857142857,
    "CCGGGCCCTA": 1.6187142857142856,
    "TAGGGCCCGG": 1.6187142857142856,
    "CCGGGGGGCC": 1.6074,
    "GGCCCCCCGG": 1.6074,
    "CCGGGCCCCC": 1.5882571428571428,
    "CCGGGGCCCC": 1.5882571428571428,
    "CCGGGGGCCC": 1.5882571428571428,
    "GGGCCCCCGG": 1.5882571428571428,
    "GGGGCCCCGG": 1.5882571428571428,
    "GGGGGCCCGG": 1.5882571428571428,
    "CCGGGCCCCA": 1.5217285714285713,
    "CCGGGGCCCA": 1.5217285714285713,
    "TGGGCCCCGG": 1.5217285714285713,
    "TGGGGCCCGG": 1.5217285714285713,
    "ACCCCCCGGG": 1.4873428571428569,
    "ACCCCCGGGG": 1.4873428571428569,
    "ACCCCGGGGG": 1.4873428571428569,
    "ACCCGGGGGG": 1.4873428571428569,
    "CCCCCCGGGT": 1.4873428571428569,
    "CCCCCGGGGT": 1.4873428571428569,
    "CCCCGGGGGT": 1.4873428571428569,
    "CCCGGGGGGT": 1.4873428571428569,
    "ACCCCCGGGC": 1.4682,
    "ACCCCGGGGC": 1.4682,
    "ACCCGGGGGC": 1.4682,
    "GCCCCCGGGT": 1.4682,
    "GCCCCGGGGT": 1.4682,
    "GCCCGGGGGT": 1.4682,
    "AGGGCCCGGG": 1.5134285714285713,
    "CCCGGGCCCT": 1.5134285714285713,
    "CCCCCGGGCC": 1.366242857142857,
    "CCCCGGGGCC": 1.366242857142857,
    "CCCGGGGGCC": 1.366242857142857,
    "GGCCCCCGGG": 1.366242857142857,
    "GGCCCCGGGG": 1.366242857142857,
    "GGCCCGGGGG": 1.366242857142857,
    "CCCCGGGCCC": 1.3471,
    "CCCGGGCCCC": 1.3471,
    "CCCGGGGCCC": 1.3471,
    "CCGGGCCCCG": 1.3471,
    "CCGGGGCCCG": 1.3471,
    "CGGGCCCCGG": 1.3471,
    "CGGGGCCCGG": 1.3471,
    "GCCCCGGGCC": 1.3471,
    "GCCCGGGGCC": 1.3471,
    "GGCCCCGGGC": 1.3471,
    "GGCCCGGGGC": 1.3471,
    "GGGCCCCGGG": 1.3471,
    "GGGCCCGGGG": 1.3471,
    "GGGGCCCGGG": 1.3471,
    "GCCCGGGCCC": 1.3279571428571428,
    "GGGCCCGGGC": 1.3279571428571428,
    "ACCCCCGGGT": 1.2461857142857142,
    "ACCCCGGGGT": 1.2461857142857142,
    "ACCCGGGGGT": 1.2461857142857142,
    "CCCGGGCCCA": 1.2805714285714287,
    "TGGGCCCGGG": 1.2805714285714287,
    "ACCCCGGGCC": 1.1250857142857142,
    "ACCCGGGGCC": 1.1250857142857142,
    "GGCCCCGGGT": 1.1250857142857142,
    "GGCCCGGGGT": 1.1250857142857142,
    "ACCCGGGCCC": 1.1059428571428571,
    "GGGCCCGGGT": 1.1059428571428571,
    "CCCGGGCCCG": 1.1059428571428571,
    "CGGGCCCGGG": 1.1059428571428571,
    "CCGGGCCCGG": 1.0218142857142856,
    "GGCCCGGGCC": 1.0039857142857143,
    "CCCCCCCCCC": 2.5361,
    "GGGGGGGGGG": 2.5361,
    "GCCCCCCCCC": 2.5169571428571422,
    "GGGGGGGGGC": 2.5169571428571422,
    "CCCCCCCCCA": 2.4695714285714283,
    "TGGGGGGGGG": 2.4695714285714283,
    "GCCCCCCCCA": 2.450428571428571,
    "TGGGGGGGGC": 2.450428571428571,
    "GGCCCCCCTA": 2.2043,
    "TAGGGGGGCC": 2.2043,
    "CGGGCCCCCG": 1.6723857142857141,
    "CGGGGCCCCG": 1.6723857142857141,
    "CGGGGGCCCG": 1.6723857142857141,
}
