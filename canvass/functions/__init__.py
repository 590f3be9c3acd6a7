"""canvass.functions"""
