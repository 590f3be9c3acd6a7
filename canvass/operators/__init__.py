"""canvass.operators"""
